import math

import numpy as np
from brute import auc
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import split


def test_random_split_exact_size(spark, events):
    s = split.split_random(events, 0.2, 1, "event_id")
    n = events.count()
    assert s.where("split = 'test'").count() == math.ceil(n * 0.2)


def test_stratified_keeps_proportions(spark, events):
    s = split.split_stratified(events, "event_type", 0.25, 3, "event_id").toPandas()
    n = len(s)
    assert (s.split == "test").sum() == math.ceil(n * 0.25)
    for _, g in s.groupby("event_type"):
        assert abs((g.split == "test").mean() - 0.25) < 2.0 / len(g)


def test_stratified_single_row_class_raises(spark, events):
    one = events.withColumn("event_type", F.when(F.col("event_id") == 0, "lonely").otherwise(F.col("event_type")))
    try:
        split.split_stratified(one, "event_type", 0.2, 1, "event_id")
    except ValueError as e:
        assert "lonely" in str(e)
    else:
        raise AssertionError("expected an error")


def test_group_split_no_group_on_both_sides(spark, events):
    s = split.split_group(events, "user_id", 0.2, 5)
    both = s.groupBy("user_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count()
    assert both == 0


def test_time_split_first_fold(spark, events):
    s = split.split_time(events, ["ts", "event_id"], 0.2).toPandas()
    n = events.count()
    fold = n // 6
    assert (s.split == "train").sum() == n - 5 * fold and (s.split == "test").sum() == fold
    assert s[s.split == "train"].ts.max() <= s[s.split == "test"].ts.min()


def test_kfold_near_equal(spark, events):
    f = split.kfold(events, 5, 1, "event_id").groupBy("fold").count().toPandas()
    assert f["count"].max() - f["count"].min() <= 1


def test_auc_matches_mann_whitney(spark, events):
    d = events.withColumn("y", (F.col("event_type") == "click").cast("int"))
    got = ev.roc_auc(d, "y", "value", 1).first()["roc_auc"]
    p = d.select("y", "value").toPandas()
    assert abs(got - auc(p.y.values, p.value.values)) < 1e-12


def test_auc_one_class_is_null(spark, events):
    d = events.withColumn("y", F.lit(1))
    assert ev.roc_auc(d, "y", "value", 1).first()["roc_auc"] is None


def test_regression_metrics(spark, events):
    d = events.select(F.col("value").alias("actual"), (F.col("value") * 0.9 + 1).alias("predicted"),
                      F.lit("all").alias("split"))
    m = ev.regression_metrics(d).first()
    p = d.toPandas()
    e = p.actual - p.predicted
    assert abs(m["rmse"] - np.sqrt((e ** 2).mean())) < 1e-9
    assert abs(m["r2"] - (1 - (e ** 2).sum() / ((p.actual - p.actual.mean()) ** 2).sum())) < 1e-9


def test_classification_metrics_weighted(spark, events):
    d = events.select(F.col("event_type").alias("actual"),
                      F.when(F.col("value") > 10, "click").otherwise(F.col("event_type")).alias("predicted"),
                      F.lit("x").alias("split"))
    m = ev.classification_metrics(d).first()
    p = d.toPandas()
    labels = sorted(set(p.actual))
    prec = rec = f1 = 0.0
    for lab in labels:
        tp = ((p.actual == lab) & (p.predicted == lab)).sum()
        sp_ = (p.predicted == lab).sum()
        sa = (p.actual == lab).sum()
        pr = tp / sp_ if sp_ else 0.0
        rc = tp / sa if sa else 0.0
        f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        prec += pr * sa
        rec += rc * sa
        f1 += f * sa
    n = len(p)
    assert abs(m["precision"] - prec / n) < 1e-12 and abs(m["f1"] - f1 / n) < 1e-12
    assert abs(m["accuracy"] - (p.actual == p.predicted).mean()) < 1e-12


def _with_nulls(spark):
    return spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("g"),
                                    F.when(F.col("id") % 10 != 0, F.col("id")).alias("gap"), (F.col("id") % 3).alias("hot"))


def test_no_split_or_fold_loses_a_row(spark):
    d = _with_nulls(spark)
    for rows in ("2", "64", "2000000"):
        spark.conf.set("spark.quarry.rowsPerBucket", rows)
        try:
            out = [split.split_random(d, 0.2, 1, "id"), split.split_stratified(d, "g", 0.2, 1, "id"), split.split_group(d, "g", 0.3, 1),
                   split.split_time(d, ["hot", "id"], 0.2, mode="holdout"), split.kfold(d, 5, 1, "id", label="g"), split.kfold(d, 5, 1, "id")]
            got = [sorted(map(tuple, o.select("id", o.columns[-1]).collect())) for o in out]
        finally:
            spark.conf.set("spark.quarry.rowsPerBucket", "64")
        assert all(len({i for i, _ in g}) == len(g) == 1000 for g in got)
        for g in got[:2] + got[3:4]:
            assert sum(s == "test" for _, s in g) == 200
        if rows == "2":
            first = got
        assert got == first


def test_null_keys_and_order_values_are_errors(spark):
    import pytest
    d = _with_nulls(spark)
    for run in (lambda: split.split_random(d, 0.2, 1, "gap"), lambda: split.split_time(d, ["gap"], 0.2),
                lambda: split.kfold(d, 5, 1, "gap"), lambda: split.split_stratified(d, "g", 0.2, 1, "gap")):
        with pytest.raises(ValueError, match="gap"):
            run()


def test_splits_do_not_shuffle_the_table(spark):
    wide = _with_nulls(spark).withColumn("payload", F.repeat(F.col("id").cast("string"), 50))
    for out in (split.split_random(wide, 0.2, 1, "id"), split.split_group(wide, "g", 0.3, 1),
                split.split_time(wide, ["hot", "id"], 0.2), split.split_stratified(wide, "g", 0.2, 1, "id")):
        plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        assert not [x for x in plan.splitlines() if x.strip(" +-:").startswith("Exchange") and "payload" in x]
        assert "SortMergeJoin" not in plan
