import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import gram, models, split
from quarry.operators.tune import tune
from quarry.plans.train import cross_validate


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 3)) * [1, 50, 0.01] + [0, 1e6, 5]
    y = x @ [2.0, 0.1, 30.0] + rng.standard_normal(500)
    rows = [(i, *map(float, r), "abc"[i % 3], float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, kind string, y double").repartition(5).persist()


def test_moments_of_folds_and_of_the_rest(spark, table):
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        table.withColumn("fold", (F.col("id") % 4).cast("int")).withColumnRenamed("y", "label"))
    got = gram.fold_moments(rows)
    p = rows.toPandas()
    z = np.column_stack([p[["a", "b", "c"]], p["label"]])
    total = gram.moments_of(z)
    for f, m in got.items():
        want = gram.moments_of(z[p["fold"] == f])
        assert m.n == want.n and np.allclose(m.mean, want.mean, rtol=1e-12) and np.allclose(m.m, want.m, rtol=1e-9)
        rest, want = total - m, gram.moments_of(z[p["fold"] != f])
        assert np.allclose(rest.m, want.m, rtol=1e-8) and np.allclose(rest.mean, want.mean, rtol=1e-12)


@pytest.mark.parametrize("kind, profile, params", [("linear", "core", {}), ("ridge", "core", {"alpha": 30.0}), ("ridge", "gui", {"alpha": 30.0})])
def test_cross_validation_equals_a_fit_per_fold(spark, table, kind, profile, params):
    # without a penalty a full set of indicators has no single solution
    inputs = ["a", "b", "c", "kind"] if kind == "ridge" else ["a", "b", "c"]
    got = cross_validate(table, "y", inputs, "r", kind, profile, 42, "id", **params).first()
    folds = split.kfold(table, 5, 42, "id").persist()
    enc = models.fit_encoder(table, inputs)
    r2, mae = [], []
    for f in range(5):
        m = models.fit(folds.where(F.col("fold") != f), "y", inputs, "r", kind, profile, 42, encoder=enc, **params)
        p = m.transform(folds.where(F.col("fold") == f)).select("y", "y_pred").toPandas()
        r2.append(1 - ((p.y - p.y_pred) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum())
        mae.append((p.y - p.y_pred).abs().mean())
    assert (got["r2_mean"], got["r2_std"], got["mae_mean"]) == pytest.approx((np.mean(r2), np.std(r2), np.mean(mae)), rel=1e-6)


def test_all_draws_cost_one_scan(spark, table, monkeypatch):
    calls = []
    real = gram.fold_moments
    monkeypatch.setattr(gram, "fold_moments", lambda rows: calls.append(rows) or real(rows))
    best, draws = tune(table, "y", ["a", "b"], "r", "ridge", "id", mode="quick", refit=False)
    assert len(calls) == 1 and draws.count() == 30
    one = cross_validate(table, "y", ["a", "b"], "r", "ridge", "core", 42, "id", **best).first()["r2_mean"]
    assert max(r["r2_mean"] for r in draws.collect()) == pytest.approx(one, abs=1e-9)
