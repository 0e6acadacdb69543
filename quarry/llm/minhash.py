"""Operator 2: near-duplicate documents by SuperMinHash.

A document's set holds its distinct five-word shingles (A-Z lower-cased, 64-bit
hashes). SuperMinHash ranks the signature's slots once per shingle: at level j a
shingle offers the value j + random to the j-th slot of its own permutation, so
ranks are correlated, every shingle fills different slots, and a document stops
at the level at which all slots are filled (one or two for usual lengths).

Documents with equal sets are one class, named by 64 bits of its set's digest; one
document's text stands for it. Bands of the signature bring classes together, and
links are confirmed on full sets, which are computed once for the classes that
share a band and written: first each bucket's members against one of them (a star,
so a bucket of n near copies costs n pairs); then, in buckets that still hold
several components, all members outside the bucket's largest component against all
others. The task that holds a bucket compares full sets and reports only links
that join components, so no row per pair is made; a bucket is dealt into parts of
``PART`` members (or ``PART_SHINGLES`` shingles) that meet part by part. Linked
classes are grouped by distributed union of stars (``components``), never on the
driver.

With 32 bands of 4 slots a pair at similarity 0.75 meets with probability
1 - 5e-6, a nearer pair more surely, in buckets of any size.

Defined cases: a text without words (null, empty, white space) has an empty set
and is linked with nothing; fewer than five words are one shingle; rows with a
null doc_id are linked with nothing and have a null component; each row is
judged by its own text, so repeated rows share a component and a doc_id that
stands on different texts may stand in several; a text of any length is read
whole; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import bounded_batches, map_by_id, mark, saved, words_of
from quarry.llm.components import components

SHINGLE = 5
SLOTS, BANDS = 128, 32
ROWS = SLOTS // BANDS
THRESHOLD = 75              # percent: 100 * intersection >= THRESHOLD * union
PART = 512                  # members of a part of a bucket, and ...
PART_SHINGLES = 2_000_000   # ... shingles of all of them, at most (in the mean)
BLOCK = 100_000             # shingles whose permutations are held at once
CACHE = 300_000             # words whose hashes a task keeps
_FULL = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    words = b" ".join(words).lower().split()    # bytes.lower changes A-Z alone
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h + w[k:k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (documents x SLOTS, uint32: level in the high byte,
    24 random bits below). Sets must not be empty."""
    out = np.full((len(sets), SLOTS), _FULL, np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        _sign(sets[at:end], out[at:end])
        at = end
    return out


def _sign(sets: list[np.ndarray], out: np.ndarray) -> None:
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(h), 1))
    flat = out.reshape(-1)
    for level in range(SLOTS):
        x = _mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        other = level + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - level)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(h))
        slot = order[rows, other]
        order[rows, other] = order[:, level]        # place `level` itself is never read again
        value = (x >> np.uint64(40)).astype(np.uint32) | np.uint32(level << 24)
        np.minimum.at(flat, doc * SLOTS + slot, value)
        open_docs = (out == _FULL).any(1)
        if not open_docs.any():
            return
        go = open_docs[doc]
        if not go.all():
            h, doc, order = h[go], doc[go], order[go]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    part = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key + part[:, :, r] + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def similar(n_a: int, n_b: int, common: int, threshold: int = THRESHOLD) -> bool:
    return 100 * common >= threshold * (n_a + n_b - common)


# ---- on Spark ------------------------------------------------------------

def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs a set."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set digest (h1, h2), bands and the text's md5 of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b["text"]]
            n = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(n)
            out = pd.DataFrame({"doc_id": b["doc_id"].to_numpy(object), "n_shingles": n})
            found = {c: np.full(len(n), None, object) for c in ("h1", "h2", "bands")}
            if len(has):
                digest, keys = _digests([sets[i] for i in has]), band_keys(signatures([sets[i] for i in has]))
                for at, i in enumerate(has):
                    found["h1"][i], found["h2"][i], found["bands"][i] = int(digest[at, 0]), int(digest[at, 1]), keys[at]
            for c, values in found.items():
                out[c] = pd.Series(values, dtype=object)
            out["m"] = pd.Series([hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in b["text"]], dtype=object)
            yield out

    return map_by_id(docs.select("doc_id", "text"), run, "n_shingles long, h1 long, h2 long, bands array<long>, m string")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and full shingle set (binary) of the ``classes`` (cid, rep): the texts of
    their rep are picked out by a mark, so none is shuffled to find them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [x for x in (shingle_set(t, hashes) for t in b["text"]) if len(x)]
            if sets:
                yield pd.DataFrame({"cid": _digests(sets)[:, 0], "s": [x.tobytes() for x in sets]})

    some = mark(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id", classes, "rep").where("marked")
    found = some.select("doc_id", "text").mapInPandas(run, "cid long, s binary")
    # one row a class: rows may repeat, and a few others share a mark
    return found.join(classes.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("s").alias("s"))


def confirmed(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) of classes whose full shingle sets reach the threshold."""
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            out.append(similar(len(x), len(y), int((both[1:] == both[:-1]).sum()), threshold))
        return pd.Series(out, dtype=bool)

    return (pairs.join(sets.select(F.col("cid").alias("u"), F.col("s").alias("su")), "u")
            .join(sets.select(F.col("cid").alias("v"), F.col("s").alias("sv")), "v")
            .where(linked("su", "sv")).select("u", "v"))


def settle(ids: list[int], roots: list[int], asks: list[bool], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links (u, v) that join the components of some members of one bucket: every
    member that ``asks`` is compared on full sets with all others, by counting along
    the members that hold each of its shingles. At most one link per component
    comes out, however many pairs are alike."""
    n = np.array([len(s) for s in sets])
    _, codes, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    owners = np.repeat(np.arange(len(sets)), n)[np.argsort(codes, kind="stable")]
    first = np.cumsum(df) - df
    now = {r: r for r in roots}

    def find(r):
        while now[r] != r:
            now[r] = now[now[r]]
            r = now[r]
        return r

    out = []
    for x in np.flatnonzero(asks).tolist():
        c = codes[ends[x] - n[x]:ends[x]]
        lens = df[c]
        at = np.repeat(first[c] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        for y in np.flatnonzero(100 * common >= threshold * (n[x] + n - common)).tolist():
            a, b = find(roots[x]), find(roots[y])
            if a != b:
                now[max(a, b)] = min(a, b)
                out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return out


def _settled(sets: DataFrame, rest: DataFrame, threshold: int) -> DataFrame:
    """Links across components inside the unresolved buckets ``rest`` (key, cid, n,
    root). Members of a bucket's largest component are compared with the others
    only. Parts p of the others (side 0) and q of the largest component (side 1)
    meet in cells (0 p, 1 q) and (0 p, 0 p')."""
    by_root = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    facts = by_root.groupBy("key").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    parts = lambda c, w: F.ceil(F.greatest(c / PART, w / PART_SHINGLES)).cast("long")
    facts = facts.select("key", F.col("top.root").alias("largest"), parts(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("n0"),
                         parts(F.col("top.c"), F.col("top.w")).alias("n1"))
    m = rest.select("key", "cid", "root").join(facts, "key").withColumn("asks", F.col("root") != F.col("largest"))
    m = m.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(7)), F.when(F.col("asks"), F.col("n0")).otherwise(F.col("n1"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    with_others = F.transform(upto("n0"), lambda i: F.struct(F.lit(0).alias("side"), F.least("part", i).alias("a"), F.greatest("part", i).alias("b")))
    with_others = F.filter(with_others, lambda c: c["a"] != c["b"])
    with_largest = F.transform(upto("n1"), lambda i: F.struct(F.lit(1).alias("side"), F.col("part").alias("a"), i.alias("b")))
    from_largest = F.transform(upto("n0"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("a"), F.col("part").alias("b")))
    cells = m.select("key", "cid", "root", "asks", F.explode(F.when(F.col("asks"), F.concat(with_others, with_largest)).otherwise(from_largest)).alias("c"))
    cells = cells.select(F.xxhash64("key", "c.side", "c.a", "c.b").alias("cell"), "cid", "root", "asks")
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(sets, "cid").repartition(tasks, "cell").sortWithinPartitions("cell", "cid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(held):
            links = settle(*zip(*held, strict=True), threshold) if len({r for _, r, _, _ in held}) > 1 else []
            return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

        now, held = None, []
        for b in batches:
            for cell, cid, root, asks, s in zip(b["cell"], b["cid"], b["root"], b["asks"], b["s"], strict=True):
                if cell != now and held:
                    yield done(held)
                    held = []
                now = cell
                held.append((cid, root, asks, np.frombuffer(s, np.uint64)))
        if held:
            yield done(held)

    return rows.mapInPandas(run, "u long, v long").distinct()


def linked_classes(docs: DataFrame, table: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, root) of the classes of equal sets that are linked to others."""
    classes = saved(table.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("h1").alias("cid")).agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    rows = classes.select("cid", "rep", "n", F.explode("bands").alias("key"))
    # a bucket's smallest member and size: one row per task and key is shuffled
    heads = rows.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = saved(rows.join(heads, "key"))
    sets = saved(_sets(docs, members.select("cid", "rep").distinct()))
    tested = members.where("cid <> head").select(F.col("cid").alias("u"), F.col("head").alias("v")).distinct()
    roots = saved(components(confirmed(sets, tested, threshold)))

    # what one star could not settle: buckets of three and more that hold several
    # components (of two, the star has compared the only pair)
    known = (members.where("size > 2").join(roots, F.col("cid") == F.col("id"), "left")
             .select("key", "cid", "n", F.coalesce("root", "cid").alias("root")))
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    # read several times: computed once
    rest = saved(known.join(mixed, "key"))
    if rest.isEmpty():
        return roots
    more = saved(_settled(sets, rest, threshold))
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).union(more))


def judged(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, m (the text's md5), n_shingles and root (a class of its component,
    null for rows without words or doc_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = saved(signed(docs))
    roots = linked_classes(docs, table, threshold)
    out = table.select("doc_id", "m", "n_shingles", "h1").join(roots, F.col("h1") == F.col("id"), "left")
    return out.select("doc_id", "m", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "h1")).alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    rows = judged(docs, threshold)
    least = rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(least, F.col("root") == F.col("r"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, less all but one of each
    component: a row with its smallest (doc_id, text digest). Rows without words
    or doc_id stay."""
    rows = saved(judged(docs, threshold).where("root is not null").groupBy("root", "doc_id", "m").agg(F.count(F.lit(1)).alias("n")))
    keep = rows.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("doc_id", "m")).alias("k"))
    rows = rows.join(keep, F.col("root") == F.col("r"))
    kept = (F.col("doc_id") == F.col("k.doc_id")) & (F.col("m") == F.col("k.m"))
    gone = rows.where(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("m").alias("__m")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__m"))
    out = docs.join(gone, same, "left_anti").select(*docs.columns)
    # a kept row that stands there several times comes back once
    again = rows.where(kept & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("m").alias("__m")).distinct()
    if again.isEmpty():
        return out
    once = docs.join(again, same).dropDuplicates(["__id", "__m"]).select(*docs.columns)
    return out.union(once)
