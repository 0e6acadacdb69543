import pytest
from pyspark.sql import functions as F

from quarry.operators import assoc, evaluate, models, prep
from quarry.plans.train import train_model
from quarry.sources import runs, sinks


@pytest.fixture(scope="module")
def dotted(part):
    return part.select("p_partkey", F.col("p_size").cast("double").alias("size.in mm"), F.col("p_type").alias("kind.of`it"),
                       F.col("p_retailprice").alias("price.usd"))


def test_association_of_names_with_dots(dotted, part):
    long, p = assoc.associate(dotted, "price.usd", "regression", ["pearson", "spearman"], inputs=["size.in mm"])
    plain, _ = assoc.associate(part.withColumn("p_size", F.col("p_size").cast("double")), "p_retailprice", "regression",
                               ["pearson", "spearman"], inputs=["p_size"])
    got = [(r["metric"], r["feature"], r["score"]) for r in long.orderBy("metric").collect()]
    assert got == [(r["metric"], "size.in mm", r["score"]) for r in plain.orderBy("metric").collect()]
    assert p.used == ["size.in mm"] and p.target == "price.usd"
    assert assoc.associate(dotted, "price.usd", "regression", ["pearson"], inputs=["size.in mm"], pairwise=True)[0].count() == 1


def test_cleaning_of_names_with_dots(dotted):
    some = dotted.withColumn("size.in mm", F.when(F.col("p_partkey") >= 3, F.col("`size.in mm`")))
    assert prep.select_existing(dotted, ["price.usd", "none"]).columns == ["price.usd"]
    assert prep.drop_incomplete(some, ["size.in mm"]).count() == some.count() - 3
    assert prep.complete_pair(some, "size.in mm", "price.usd").count() == some.count() - 3
    assert dict(prep.coerce_numeric(some, ["size.in mm"]).dtypes)["size.in mm"] == "double"


def test_training_and_saved_runs_with_dots(spark, dotted, tmp_path):
    out = f"file://{tmp_path}/run"
    r = train_model(dotted, "price.usd", ["size.in mm", "kind.of`it"], "regression", "ridge", key="p_partkey", cv=False, out_dir=out)
    assert r.fitted.inputs == ["size.in mm", "kind.of`it"] and r.fitted.feature_names()[0] == "size.in mm"
    scored = runs.load_model(spark, out).transform(dotted)
    assert scored.columns == [*dotted.columns, "price.usd_pred"]
    assert scored.where(F.col("`price.usd_pred`").isNull()).count() == 0
    m = runs.load_manifest(spark, out)
    assert m["features"] == ["size.in mm", "kind.of`it"] and m["target"] == "price.usd"
    k = models.fit(dotted, "price.usd", ["size.in mm"], "regression", "knn", key="p_partkey")
    assert k.transform(dotted.limit(5)).columns[-1] == "price.usd_pred"


def test_only_whole_runs_are_committed(spark, part, tmp_path):
    root = f"file://{tmp_path}/runs"
    d = part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    train_model(d, "p_retailprice", ["p_size"], key="p_partkey", cv=False, out_dir=f"{root}/whole", test_size=0.3)
    sinks.write_metrics(spark.createDataFrame([("test", 1.0)], "split string, r2 double"), f"{root}/torn")
    assert [r["name"] for r in runs.list_runs(spark, root).collect()] == ["torn", "whole"]
    assert [r["name"] for r in runs.list_runs(spark, root, committed=True).collect()] == ["whole"]


def test_constant_columns_standardise_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 6.0)], "a double, b double")
    assert [r["a"] for r in prep.standardize(df, ["a", "b"]).orderBy("b").collect()] == [0.0, 0.0, None]


def test_auc_without_label(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.05), (1, None), (0, float("nan"))], "label int, score double")
    assert evaluate.roc_auc(df).first()["roc_auc"] == 1.0
