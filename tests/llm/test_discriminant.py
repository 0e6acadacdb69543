import zlib

import numpy as np
import pytest

from quarry.llm import discriminant as d

SF01 = "/root/testdata/sf0.01"


def plain_scores(z, y, train):
    """Class densities written out with inverse and determinant."""
    mu, sd = z[train].mean(0), np.maximum(z[train].std(0), d.FLOOR)
    w = (z - mu) / sd
    parts = [w[train & (y == c)] for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    n = np.array([len(p) for p in parts])
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    log = []
    for c in (0, 1):
        s = 0.7 * covs[c] + 0.3 * pooled
        s = 0.99 * s + 0.01 * np.trace(s) / len(s) * np.eye(len(s))
        diff = w - parts[c].mean(0)
        log.append(np.log(n[c] / n.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def test_scores_match_plain_densities_and_hold_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    got = d.quality_scores(docs, labels).toPandas().set_index("doc_id").sort_index()
    pdf = docs.toPandas().merge(labels.toPandas(), on="doc_id", how="left").sort_values("doc_id")
    z = d.transform(np.array([d.statistics(t)[5] for t in pdf["text"]]))
    out = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in pdf["doc_id"]])
    y = pdf["quality"].to_numpy()
    want = plain_scores(z, y, ~out & ~np.isnan(y))
    assert (got["held_out"].to_numpy() == out).all()
    assert np.abs(got["score"].to_numpy() - want).max() < 1e-5
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    test = out & ~np.isnan(y)
    assert (got["predicted"].to_numpy()[test] == y[test]).mean() > 0.97


def test_same_model_on_any_partitioning(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet").limit(300), spark.read.parquet(f"{SF01}/labels.parquet")
    docs = docs.union(docs.limit(20)).cache()
    one = {tuple(r) for r in d.quality_scores(docs.repartition(1), labels).collect()}
    assert one == {tuple(r) for r in d.quality_scores(docs.repartition(7), labels).collect()}
    docs.unpersist()


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a = d.quality_scores(docs, labels).orderBy("doc_id").collect()
    assert a == d.quality_scores(docs, flipped).orderBy("doc_id").collect()


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (6, 1), (8, 0), (10, 1), (7, 1), (4, 0)], "doc_id long, quality int")
    for labels in (none, some):
        rows = d.quality_scores(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
        assert {r["doc_id"] for r in rows} >= {None, 9007199254740993}
    assert {r["score"] for r in d.quality_scores(odd_docs, none).collect()} == {0.5}
    assert d.quality_scores(no_docs, some).count() == 0


def test_one_class_gives_its_smoothed_share():
    m = d.fit_moments(np.array([0, 8]), np.zeros((2, 3)), np.zeros((2, 3, 3)))
    assert d.predict(m, np.zeros((2, 3))).tolist() == pytest.approx([0.9, 0.9])
