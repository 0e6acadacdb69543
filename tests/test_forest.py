"""Forests (E5, E12): the learner against MLlib's own, and its bags."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import forest, models


def _table(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 30, n), rng.integers(0, 8, n), rng.choice(["p", "q", "r", "s"], n)
    y = a * 3.0 + b * (c == "q") * 5.0 + rng.normal(size=n)
    k = np.where(a + b + rng.integers(0, 6, n) > 20, "x", np.where(c == "r", "y", "z"))
    rows = list(zip(range(n), a.astype(float).tolist(), b.astype(float).tolist(), c.tolist(), y.tolist(), k.tolist(), strict=True))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, k string")


def _plain(task, df, target, **params):
    """The same estimator fitted by MLlib itself."""
    m = models.fit(df, target, ["a", "b", "c"], task, "rf", **params)
    est = models._estimator(task, "rf", dict(models.PROFILES[(task, "rf")]["core"], **params), df.count(), 0.0, 42)
    x = df
    for stage in m.pipeline.stages[:-1]:
        x = stage.transform(x)
    if task == "classification":
        from pyspark.ml.feature import StringIndexer
        x = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(x).transform(x)
    else:
        x = x.withColumn("label", x[target])
    return m, x, est.fit(x)


@pytest.mark.parametrize("local", [2_000_000, 900])
@pytest.mark.parametrize("task,target", [("regression", "y"), ("classification", "k")])
def test_equals_mllib(spark, monkeypatch, task, target, local):
    """One tree on all rows and inputs is MLlib's, grown in one task or from the top."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", local)
    monkeypatch.setattr(forest, "LEAST_ROWS", 400)
    every = models._estimator
    monkeypatch.setattr(models, "_estimator", lambda *a: every(*a).setFeatureSubsetStrategy("all"))
    df = _table(spark).cache()
    m, x, want = _plain(task, df, target, trees=1, bootstrap=False, max_depth=6, min_leaf_share=0.01)
    got = m.pipeline.stages[-1]
    assert type(got) is type(want) and got.getNumTrees == want.getNumTrees == 1
    assert got.totalNumNodes == want.totalNumNodes
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    column = "prediction" if task == "regression" else "probability"
    a = {r["id"]: r[column] for r in got.transform(x).collect()}
    b = {r["id"]: r[column] for r in want.transform(x).collect()}
    assert all(np.allclose(a[i] if task == "regression" else a[i].toArray(), b[i] if task == "regression" else b[i].toArray()) for i in b)


def test_bags_and_subsets(spark, monkeypatch):
    """Trees differ, a fit repeats itself, and the forest predicts better than a constant."""
    monkeypatch.setattr(forest, "LEAST_ROWS", 400)
    df = _table(spark).cache()
    fits = [models.fit(df, "k", ["a", "b", "c"], "classification", "rf", trees=12) for _ in range(2)]
    trees = [m.pipeline.stages[-1] for m in fits]
    assert trees[0].totalNumNodes == trees[1].totalNumNodes
    assert len({t.numNodes for t in trees[0].trees}) > 1
    hit = fits[0].transform(df).selectExpr("avg(int(k = k_pred)) AS hit").first()["hit"]
    assert hit > 0.8


def test_least_leaf_and_cells():
    """Every leaf holds the least number of rows; unlisted cells count as the usual one."""
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 2, 4000) * (rng.random(4000) < 0.1), rng.normal(size=4000)], 1)
    y = x[:, 0] * 4 + np.sin(3 * x[:, 1])
    bins = forest.Bins(x, 255)
    cells = bins.numbers(x)
    other = cells != bins.usual
    rows = forest.Rows(other.sum(1), cells[other], y - y.mean(), rng.poisson(1.0, 4000).astype(np.uint8))
    rows = rows.where(rows.w > 0)
    p = {"classes": 0, "leaf": 25, "depth": 30, "take": 2, "seed": 1}
    heap, cell, total = forest.grow(rows, 1, 0, bins, p)
    assert len(set(heap)) == len(heap) and total[0, 0] == rows.w.sum()
    assert total[:, 0].min() >= 25
    inner = {h: t for h, c, t in zip(heap, cell, total, strict=True) if c >= 0}
    every = dict(zip(heap, total, strict=True))
    assert all(np.allclose(t, every[2 * h] + every[2 * h + 1]) for h, t in inner.items())
    assert (total[cell < 0, 2] - total[cell < 0, 1] ** 2 / total[cell < 0, 0]).sum() < 0.1 * (total[0, 2])


def test_table_of_a_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, y double")
    m = models.fit(df, "y", ["a"], "regression", "rf", trees=20)
    assert m.pipeline.stages[-1].getNumTrees == 20
    assert all(2.0 <= r["y_pred"] <= 3.0 for r in m.transform(df).collect())


def _two_inputs(spark, n=3000):
    """Two inputs of many values and three classes, in several files' worth of tasks."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 40, n), rng.normal(size=n).round(1)
    k = np.where(a + 10 * b + rng.integers(0, 30, n) > 35, "x", np.where(a % 7 > 4, "y", "z"))
    rows = list(zip(range(n), a.astype(float).tolist(), b.tolist(), (a * b + rng.normal(size=n)).tolist(), k.tolist(), strict=True))
    return spark.createDataFrame(rows, "id long, a double, b double, y double, k string")


def _grown(df, task, target):
    m = models.fit(df, target, ["a", "b"], task, "rf", trees=5, min_leaf_share=0.002)
    column = "prediction" if task == "regression" else "probability"
    got = {r["id"]: r[column] for r in m.pipeline.transform(df).collect()}
    return m, {i: v if task == "regression" else tuple(v) for i, v in got.items()}


@pytest.mark.parametrize("task,target", [("regression", "y"), ("classification", "k")])
def test_bags_hold_equal_rows_once(spark, monkeypatch, task, target):
    """Rows that the bins do not tell apart are one row of a bag; kept bags, top splits and
    one task give the same forest."""
    monkeypatch.setattr(forest, "LEAST_ROWS", 400)
    sent, pooled, top = [], [], []
    every = {name: getattr(forest, name) for name in ("_blocks", "_pooled", "_top")}
    monkeypatch.setattr(forest, "_blocks", lambda *a: sent.append(every["_blocks"](*a)) or sent[-1])
    monkeypatch.setattr(forest, "_pooled", lambda *a: pooled.append(a[1]) or every["_pooled"](*a))
    monkeypatch.setattr(forest, "_top", lambda *a: top.append(every["_top"](*a)) or top[-1])
    df = _two_inputs(spark).select("id", (F.col("a") % 6).alias("a"), F.round("b").alias("b"), "y", "k").cache()
    _, want = _grown(df, task, target)
    ways = 6 * df.select("b").distinct().count() * (3 if task == "classification" else 1)
    assert all(r["rows"] <= ways < r["n"] for r in sent[0].selectExpr("rows", "length(which) / 4 AS n").collect())
    assert not pooled and not top[0][0][0]
    monkeypatch.setattr(forest, "LOCAL_CELLS", 60)
    for kept in (True, False):
        monkeypatch.setattr(forest, "POOLED_SHARE", 1 if kept else 10**9)
        pooled.clear()
        _, got = _grown(df, task, target)
        assert bool(pooled) == kept and top[-1][0][0]
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_cells_are_scored_once(spark, monkeypatch):
    """Every row gets MLlib's own prediction, one with a missing input too."""
    df = _two_inputs(spark).cache()
    m, _ = _grown(df, "classification", "k")
    odd = df.unionByName(spark.createDataFrame([(-1, None, 0.3, 0.0, "x"), (-2, 3.0, None, 0.0, "x"), (-3, 1e9, -1e9, 0.0, "y")], df.schema))
    want = {r["id"]: r["k_pred"] for r in m.transform(odd).collect()}
    monkeypatch.setattr(forest, "LARGE_NODES", 1)
    asked = []
    monkeypatch.setattr(type(m.pipeline.stages[-1]), "transform", lambda self, x, every=type(m.pipeline.stages[-1]).transform: asked.append(x) or every(self, x))
    assert {r["id"]: r["k_pred"] for r in m.transform(odd).collect()} == want
    assert m.transform(odd).columns == [*odd.columns, "k_pred"]
    cuts = m.pipeline.stages[-1].cuts
    assert asked[0].columns == ["__cell", "features"] and asked[0].count() <= (len(cuts[0]) + 2) * (len(cuts[1]) + 2) < odd.count()
