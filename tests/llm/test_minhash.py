import re

import numpy as np
import pytest

from quarry.llm import minhash
from quarry.llm.components import components

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def brute(rows, threshold=75):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets, holders = {}, {}
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        s = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets[i] = s
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, rows):
    want = brute(rows)
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(want)
    for i, (n, c) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    check(minhash.near_duplicates(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("part, shingles", [(512, 2_000_000), (4, 2_000_000), (512, 150)])
def test_groups_chains_and_common_passages(spark, monkeypatch, part, shingles):
    """A large group of near copies, chains whose ends differ, and many documents
    that share one passage; buckets whole and in parts."""
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "PART_SHINGLES", shingles)
    rng = np.random.default_rng(3)
    pick = lambda n: [f"{WORDS[i % 19]}{i}" for i in rng.integers(0, 5000, n)]
    rows, base, passage = [], pick(120), pick(60)
    for _ in range(60):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 9)):
            w[at] = "changed"
        rows.append(" ".join(w))
    chain = pick(100)
    for _ in range(25):
        chain = chain[3:] + pick(3)
        rows.append(" ".join(chain))
    rows += [" ".join(pick(int(n)) + passage) for n in rng.integers(5, 60, 80)]
    rows += ["", "one two", "ONE two", "three", rows[0], rows[0].upper()]
    rows = list(enumerate(rows, start=1000))
    check(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_rounds_of_components_start_few_tasks(spark):
    """Few links in many partitions: the driver keeps what it knows of every task."""
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 40)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "")
        got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {i: 1 if i < 100 else 100 for i in (*range(1, 41), *range(100, 140))}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert 0 < tasks < 2000


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(500, 500), (None, 3), (200, 100)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1}
    assert {got[i] for i in [200, *range(100, 140)]} == {100}
    assert 500 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (20, 400):
        errors = []
        for _ in range(80):
            a = np.unique(rng.integers(0, 2**62, n + n // 4).astype(np.uint64))
            x, y = a[:n], a[n // 4:]
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            s = minhash.signatures([x, y])
            errors.append((s[0] == s[1]).mean() - j)
        j = 0.6
        assert abs(np.mean(errors)) < 0.012
        assert np.std(errors) < (j * (1 - j) / minhash.SLOTS) ** 0.5       # plain MinHash has this


def test_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["n_shingles"] == 0 and by[k]["kept"] for k in (2, 3, 4))
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[9007199254740993]["component_id"] == 9007199254740993
    kept = minhash.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert minhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (3, b + " more", "z"), (4, a.upper(), "x"), (5, "", "e"), (5, "", "e"), (5, None, "e"),
            (6, "lone words", "l"), (6, "lone words", "l"), (6, "lone words", "other"), (7, "c c c", "p"), (7, "d d d", "q"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted([tuple(r) for r in minhash.without_copies(docs).collect()], key=repr)
    lone = [r for r in got if r[0] == 6]
    assert len(lone) == 1 and lone[0][1] == "lone words"
    rest = [(1, a, "x"), (2, b, "y"), (5, "", "e"), (5, "", "e"), (5, None, "e"), (7, "c c c", "p"), (7, "d d d", "q"), (None, a, "n")]
    assert [r for r in got if r[0] != 6] == sorted(rest, key=repr)
    by = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(2, 36, 1), (2, 36, 2), (3, 37, 2), (4, 36, 1)} <= by
