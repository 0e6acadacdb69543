import numpy as np
import pytest
from brute import avg_rank, dcor, mi_cd
from pyspark.sql import functions as F

from quarry.operators import assoc
from quarry.operators.dcor import dcor_pair
from quarry.operators.mi import mi_classif_feature, scaled_jittered


def test_pearson_spearman_match_numpy(spark, part):
    long, prep = assoc.associate(part, "p_retailprice", "r", ["pearson", "spearman"],
                                 inputs=["p_size", "p_partkey"])
    got = {(r["metric"], r["feature"]): r["score"] for r in long.collect()}
    p = part.select("p_size", "p_partkey", "p_retailprice").toPandas().astype(float)
    for f in ["p_size", "p_partkey"]:
        assert abs(got[("pearson", f)] - np.corrcoef(p[f], p.p_retailprice)[0, 1]) < 1e-9
        assert abs(got[("spearman", f)] - np.corrcoef(avg_rank(p[f]), avg_rank(p.p_retailprice))[0, 1]) < 1e-9


def test_constant_input_skipped_and_reported(spark, part):
    df = part.withColumn("const", F.lit(3.0))
    long, prep = assoc.associate(df, "p_retailprice", "r", ["pearson"], inputs=["p_size", "const"])
    assert prep.skipped == ["const"] and prep.used == ["p_size"]
    rep = prep.report().first()
    assert rep["rows_in"] == rep["rows_used"] == part.count()


def test_spearman_invariant_under_monotone_map(spark, part):
    a, _ = assoc.associate(part, "p_retailprice", "r", ["spearman"], inputs=["p_size"])
    b, _ = assoc.associate(part.withColumn("p_size", F.exp(F.col("p_size") / 10.0)),
                           "p_retailprice", "r", ["spearman"], inputs=["p_size"])
    assert abs(a.first()["score"] - b.first()["score"]) < 1e-12


def test_topk_and_wide(spark, part):
    long, _ = assoc.associate(part, "p_retailprice", "r", ["pearson", "spearman"],
                              inputs=["p_size", "p_partkey"], topk=1)
    assert long.count() == 2
    wide = assoc.wide_table(long, ["pearson", "spearman"]).collect()
    assert all(r["combined"] is not None for r in wide)


def test_mi_classif_matches_brute_force(spark, events):
    got = mi_classif_feature(events, "value", "event_type", "event_id", 3, 0, True).first()["score"]
    d = scaled_jittered(events.select(F.col("event_id").alias("__key"), "value", "event_type"),
                        "value", "__key", 0, True, "value").toPandas()
    ref = mi_cd(d["__x"].values, d.event_type.astype("category").cat.codes.values, 3)
    assert abs(got - ref) < 1e-9


def test_mi_classif_without_jitter_ties(spark, events):
    got = mi_classif_feature(events, "user_id", "event_type", "event_id", 3, 0, False).first()["score"]
    d = scaled_jittered(events.select(F.col("event_id").alias("__key"), "user_id", "event_type"),
                        "user_id", "__key", 0, False, "user_id").toPandas()
    ref = mi_cd(d["__x"].values, d.event_type.astype("category").cat.codes.values, 3)
    assert abs(got - ref) < 1e-9


@pytest.mark.parametrize("x,y", [("user_id", "value"), ("event_id", "value")])
def test_dcor_matches_brute_force(spark, events, x, y):
    p = events.select(x, y).toPandas().astype(float)
    assert abs(dcor_pair(events, x, y) - dcor(p[x].values, p[y].values)) < 1e-9


def test_dcor_linear_map_is_one(spark, events):
    d = events.withColumn("z", F.col("value") * -3.0 + 7.0)
    assert abs(dcor_pair(d, "value", "z") - 1.0) < 1e-9


def test_small_n_gives_null_not_failure(spark, events):
    two = events.orderBy("event_id").limit(2)
    long, _ = assoc.associate(two, "value", "r", ["mi"], inputs=["user_id"], key="event_id")
    assert long.first()["score"] is None


@pytest.mark.parametrize("table,x,y,key", [("orders", "o_custkey", "o_totalprice", "o_orderkey"),
                                           ("events", "user_id", "value", "event_id")])
def test_mi_regression_matches_brute_force(spark, table, x, y, key):
    from brute import mi_cc

    from quarry.operators.mi_reg import mi_regression_feature
    df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    got = mi_regression_feature(df, x, y, key, 3, 0, True).first()["score"]
    d = df.select(F.col(key).alias("__key"), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    d = scaled_jittered(d, x, "__key", 0, True, x).withColumnRenamed("__x", "__xs")
    d = scaled_jittered(d, y, "__key", 0, True, y).toPandas()
    assert abs(got - mi_cc(d["__xs"].values, d["__x"].values, 3)) < 1e-9
