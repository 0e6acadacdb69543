import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, packing, token_counts

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def parts():
    vocabulary = bpe.read_ranks(PATH)
    return vocabulary, bpe.PerfectHash(vocabulary)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(parts):
    vocabulary, perfect = parts
    assert sorted(perfect.slots) == list(range(len(vocabulary)))
    assert all(perfect.candidate(t) == i for i, t in enumerate(vocabulary))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(parts, library, text):
    text = text.encode("utf-8", "replace").decode()
    enc = bpe.Encoder(*parts, P.PATTERN)
    ids = enc.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert enc.decode(ids) == text.encode()


def test_queries_match_the_libraries(spark, parts, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.round_trip(docs, PATH, P.PATTERN).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    file = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    file.encode_special_tokens = True
    fast = bpe.FastIds(*parts, P.PATTERN)
    for t in [*list(texts.values())[:100], "<|endoftext|> \n\n x", "é" * 300]:
        assert fast(t).tolist() == file.encode(t, add_special_tokens=False).ids
    fast.LONG_TEXT = 10
    assert fast("ein langer Text  mit 12345 Zeichen\n\n").tolist() == library.encode_ordinary("ein langer Text  mit 12345 Zeichen\n\n")


def test_cache_generations_do_not_change_ids(parts, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    enc = bpe.Encoder(*parts, P.PATTERN)
    for t in ["a bb ccc dddd eeeee ffffff ggggggg " * 3, "zz yy xx"] * 3:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def check_packed(rows, ids_of, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        ids = np.append(ids_of(i), 2).astype("<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        at = 0
        for p in pieces:
            assert p["start"] == at
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:at].tobytes())
        assert at == len(ids) and all(p["length"] == capacity for p in pieces[1:])
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


@pytest.mark.parametrize("block", [20_000, 30])
def test_packing_is_gapless_and_tight(spark, library, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_DOCS", block)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    n, total = check_packed(rows, lambda i: library.encode_ordinary(texts[i]))
    assert n <= 1.02 * total / 1024 + 1 + 200 / block
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(0).integers(1, 900, 800))[::-1]
    s, off = packing.best_fit(lengths, 1024, docs=3, cost=900_000, rule=rule)
    for k in range(s.max() + 1):
        own = lengths[s == k]
        assert own.sum() <= 1024 and len(own) <= 3 and (own.astype(int) ** 2).sum() <= 900_000
    assert packing.best_fit(np.zeros(0, int))[0].size == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1024]), 1024, cost=1000)


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = packing.pack_documents(odd_docs).collect()
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert [r["length"] for r in empty] == [1, 1]
    assert len([r for r in rows if r["doc_id"] == 7]) == 2
    assert packing.pack_documents(no_docs).count() == 0
    got = bpe.round_trip(odd_docs, PATH, P.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        ids = np.array(library.encode_ordinary((texts[r["doc_id"]] or "")[:300_000]) if r["doc_id"] != 11 else [], "<u4")
        if r["doc_id"] != 11:
            assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0


def test_packed_ids_are_those_of_the_tokenizers_file(spark, parts, monkeypatch):
    file = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = dict(enumerate([f"a {end} b", end, f"{end}{end}", f" \n\n{end}\n \n x", f"<|{end}|>", end[:-1], f"{end} word " * 700, "plain", f"é漢{end}🎉"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids_of = {i: file.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    rows = packing.pack_documents(docs, with_ids=True).collect()
    check_packed(rows, ids_of.get)
    for i, ids in ids_of.items():
        own = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]))
        assert np.frombuffer(own, "<u4").tolist() == [*ids, packing.END_ID]
    fast = bpe.FastIds(*parts, P.PATTERN, bpe.read_added(P.path("byte_bpe_50k.json")))
    fast.LONG_TEXT = 10
    assert all(fast(t).tolist() == ids_of[i] for i, t in texts.items())


def brute_spans(text, library):
    """(first character, end character) of each token, token by token."""
    raw, at, out = text.encode(), 0, []
    for t in library.encode_ordinary(text):
        end = at + len(library.decode_single_token_bytes(t))
        first = len(raw[:at + 1].decode("utf-8", "ignore")) if (raw[at] & 0xC0) != 0x80 else None
        starts = [i for i in range(len(raw)) if (raw[i] & 0xC0) != 0x80]
        a = max(k for k, s in enumerate(starts) if s <= at)
        b = max(k for k, s in enumerate(starts) if s <= end - 1) + 1
        out.append((a, b))
        at = end
        del first
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_counts_match_brute_force(spark, library, rule):
    texts = {1: "ab cd\n\n\n  ef\ngh", 2: "é漢字🎉\n🎉🎉 x\n", 3: "", 4: None, 5: "\n", 6: "one line", 7: "a\n\n\n\nb" * 5}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in token_counts.count_lines(docs, PATH, P.PATTERN, rule).collect():
        got[r["doc_id"], r["section"]] = r
    for i, text in texts.items():
        text = text or ""
        lines = [x + "\n" for x in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        owner = [k for k, x in enumerate(lines) for _ in x]
        want = [0.0] * len(lines)
        for a, b in brute_spans(text, library) if text else []:
            held = owner[a:b]
            if rule == "start":
                want[held[0]] += 1
            elif rule == "majority":
                want[max(sorted(set(held)), key=held.count)] += 1
            else:
                for k in held:
                    want[k] += 1 / len(held)
        assert [k for d, k in sorted(got) if d == i] == list(range(len(lines)))
        assert [got[i, k]["n_tokens"] for k in range(len(lines))] == pytest.approx(want), (i, rule)
        assert "".join(text[got[i, k]["start"]:got[i, k]["start"] + got[i, k]["n_chars"]] for k in range(len(lines))) == text


def test_counts_of_whole_tables(spark, odd_docs, no_docs, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    per = token_counts.count_lines(docs, PATH, P.PATTERN).groupBy("doc_id").sum("n_tokens").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r[0]: r[1] for r in per} == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}
    rows = token_counts.count_lines(odd_docs, PATH, P.PATTERN).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert token_counts.count_lines(no_docs, PATH, P.PATTERN).count() == 0
    fields = token_counts.count_fields(odd_docs, ["lang", "text"], PATH, P.PATTERN).collect()
    assert len(fields) == 2 * odd_docs.count()
    with pytest.raises(ValueError):
        token_counts.count_lines(docs, PATH, P.PATTERN, rule="other")
