import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.params import canonical_model, canonical_task, resolve_seed
from quarry.operators.models import fit
from quarry.plans import score as sc
from quarry.sources import runs, sinks


@pytest.fixture(scope="module")
def xy(part):
    return part.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _truth(xy):
    p = xy.toPandas()
    x, y = p.x.values, p.y.values
    xc, yc = x - x.mean(), y - y.mean()
    return x, y, (xc * xc).sum(), (xc * yc).sum(), len(x)


def test_ridge_and_lasso_closed_forms(spark, xy):
    x, y, sxx, sxy, n = _truth(xy)
    r = fit(xy, "y", ["x"], "r", "ridge").pipeline.stages[-1]
    assert abs(r.coefficients[0] - sxy / (sxx + 1.0)) < 1e-9
    xs_sd = x.std()
    g = fit(xy, "y", ["x"], "r", "lasso", profile="gui").pipeline.stages[-1]
    c = sxy / n / xs_sd
    assert abs(g.coefficients[0] - np.sign(c) * max(abs(c) - 0.001, 0)) < 1e-8


def test_logistic_matches_newton(spark, spark_labels):
    m = fit(spark_labels, "quality", ["x"], "c", "linear").pipeline.stages[-1]
    p = spark_labels.toPandas()
    X = np.c_[np.ones(len(p)), p.x.values]
    Y = p.quality.values
    w = np.zeros(2)
    for _ in range(50):
        pr = 1 / (1 + np.exp(-X @ w))
        H = (X.T * (pr * (1 - pr))) @ X + np.diag([0, 1.0])
        w -= np.linalg.solve(H, X.T @ (pr - Y) + np.r_[0, w[1]])
    assert abs(m.intercept - w[0]) < 1e-6 and abs(m.coefficients[0] - w[1]) < 1e-6


@pytest.fixture(scope="module")
def spark_labels(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    doc = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return lab.join(doc, "doc_id").select((F.col("n_chars") / 1000.0).alias("x"), "quality", "lang")


def test_unseen_and_null_category_score_as_zero_vector(spark, part):
    m = fit(part, "p_retailprice", ["p_size", "p_brand"], "r", "linear")
    new = part.limit(3).withColumn("p_brand", F.when(F.col("p_partkey") % 2 == 0, "Brand#999")
                                   .otherwise(F.lit(None)))
    out = m.transform(new).collect()
    assert len(out) == 3 and all(r["p_retailprice_pred"] is not None for r in out)


def test_save_load_and_score_clean(spark, part):
    m = fit(part, "p_retailprice", ["p_size"], "r", "linear")
    root = sinks.scratch_path(spark, "test-run")
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42)
    back = runs.load_model(spark, root)
    raw = part.select(F.when(F.col("p_partkey") < 10, F.lit("12d")).otherwise(F.col("p_size").cast("string"))
                      .alias("P_Size"))
    r = sc.score_clean(back, raw)
    assert r.rows_read == part.count() and r.rows_used == part.count() - part.where("p_partkey < 10").count()
    assert r.predictions.columns == ["p_size", "p_retailprice_pred"]


def test_classifier_labels_round_trip(spark, spark_labels):
    m = fit(spark_labels, "quality", ["x", "lang"], "c", "rf", trees=5, max_depth=4)
    out = m.transform(spark_labels).select("quality_pred").distinct().collect()
    assert {r[0] for r in out} <= {0, 1}


def test_multiclass_boosting_predicts_classes(spark, events):
    m = fit(events, "event_type", ["value"], "c", "hgb", rounds=3)
    preds = {r[0] for r in m.transform(events).select("event_type_pred").distinct().collect()}
    assert preds <= set(r[0] for r in events.select("event_type").distinct().collect())


def test_param_normalisers():
    assert canonical_task("CLF") == "classification" and canonical_task("cls") == "classification"
    assert canonical_model("r", "Random_Forest") == "rf"
    with pytest.raises(ValueError):
        canonical_model("c", "lasso")
    assert resolve_seed("  7 ") == 7 and resolve_seed("bad") == 42


def test_knn_regression_matches_brute_force(spark, events):
    from quarry.operators import split
    ev = events.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = split.split_random(ev, 0.2, 42, "event_id")
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    m = fit(tr, "value", ["ts_s", "user_id"], "r", "knn", key="event_id")
    got = m.transform(te).select("event_id", "value_pred").toPandas().set_index("event_id")["value_pred"]
    a = tr.select("event_id", "ts_s", "user_id", "value").toPandas()
    b = te.select("event_id", "ts_s", "user_id").toPandas()
    cols = ["ts_s", "user_id"]
    mu, sd = a[cols].mean(), a[cols].std(ddof=1)
    A, B = ((a[cols] - mu) / sd).values, ((b[cols] - mu) / sd).values
    for i in range(len(B)):
        d = np.sqrt(((A - B[i]) ** 2).sum(1))
        o = np.lexsort((a.event_id.values, d))[:5]
        assert abs(a.value.values[o].mean() - got[b.event_id.values[i]]) < 1e-9


def test_knn_save_load_round_trip(spark, events):
    ev = events.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    m = fit(ev, "event_type", ["value", "ts_s"], "c", "knn", key="event_id")
    root = sinks.scratch_path(spark, "test-knn")
    runs.save_model(m, root)
    runs.save_manifest(spark, root, m, 42)
    back = runs.load_model(spark, root)
    a = m.transform(ev).orderBy("event_id").select("event_type_pred").collect()
    b = back.transform(ev).orderBy("event_id").select("event_type_pred").collect()
    assert a == b
