import numpy as np
import pytest

from quarry.llm import ann

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
        out[i] = [(j, d[n]) for n, j in sorted(enumerate(ids), key=lambda t: (d[t[0]], t[1])) if j != i][:k]
    return out


@pytest.mark.parametrize("block", [16_384, 90])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = df.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 10 == 0], 10)
    got = {}
    for r in ann.nearest(df, "vec_id % 10 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 11))
        exact = np.sqrt(((x[[ids.index(r["vec_id"]) for r in found]] - x[ids.index(q)]) ** 2).sum(1))
        assert np.abs(exact - [r["score"] for r in found]).max() < 1e-12
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & {j for j, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.95


def test_ties_few_candidates_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]),
            (10, [None, 1.0]), (11, [inf, 1.0]), (12, []), (None, [1.0, 0.0]), (13, [1.0, 2.0, 3.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in ann.nearest(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 5, 1.0)]
    assert ann.nearest(df, "vec_id = 8").count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0").count() == 0
