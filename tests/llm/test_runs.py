import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import runs

SF001 = "/root/testdata/sf0.001"


def brute(x):
    """Every period, every stretch; a stretch counts with its least period."""
    n, out, seen = len(x), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def pieces():
    word = st.integers(0, 3)
    unit = st.lists(word, min_size=1, max_size=7)
    tail = st.tuples(unit, st.integers(1, 9), st.integers(0, 6)).map(lambda t: t[0] * t[1] + t[0][:t[2]])
    return st.lists(st.one_of(st.lists(word, max_size=20), tail), max_size=6).map(lambda x: sum(x, []))


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces(), min_size=1, max_size=5))
def test_all_runs_found(docs):
    got = runs.find_runs([np.array(x, np.int64) for x in docs])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(x) for x in docs]


def test_grammar_replaces_every_place_and_runs_are_found_in_long_texts():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 50, 40)
    x = np.concatenate([np.concatenate([phrase, rng.integers(50, 90, int(rng.integers(1, 9)))]) for _ in range(60)])
    nodes = runs.Nodes()
    doc = np.zeros(len(x), np.int64)
    opens = runs.re_pair(x, doc, 1, nodes)
    first, rule, at = nodes.done()
    assert opens.sum() < len(x) / 4
    for k in range(nodes.n):
        places = at[rule == k]
        size = first[2, k] - first[0, k]
        assert len(places) >= 2 and first[0, k] in places
        assert all((x[p:p + size] == x[first[0, k]:first[2, k]]).all() for p in places)
    assert runs.find_runs([np.zeros(100_000, np.int64)])[0].tolist() == [[0, 100_000, 1]]
    assert runs.find_runs([np.resize(np.arange(9_000), 40_000)])[0].tolist() == [[0, 40_000, 9_000]]


def test_report_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("length(text) < 20000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = runs.periodic_runs(docs).collect()
    assert len(rows) == len(texts)
    assert sum(r["n_runs"] > 0 for r in rows) > 5
    for r in rows:
        assert tuple(r[c] for c in runs.COLUMNS) == plain(texts[r["doc_id"]], r["doc_id"])


def test_ties_take_the_first_run():
    words = [w.encode() for w in ("a b " * 5 + "x " + "c d " * 5 + "y " + "e e e e e e").split()]
    assert runs.report([words])[0][:5] == (3, 22, 6, 1, 6000)
    words = [w.encode() for w in ("a b " * 5 + "x " + "c d " * 5).split()]
    assert runs.report([words])[0][:5] == (2, 0, 10, 2, 5000)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = runs.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["doc_id"] for r in rows} >= {None, 9007199254740993}
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert (r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) == (0, None, empty, empty)
    by = {r["doc_id"]: r for r in runs.periodic_runs(odd_docs, change=None).collect()}
    assert (by[5]["n_runs"], by[5]["length"], by[5]["period"]) == (1, 60_000, 977)
    assert by[6]["length"] == 60_000
    assert runs.periodic_runs(no_docs).count() == 0
