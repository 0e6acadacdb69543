"""Saved runs.

A run is a folder: ``model/`` (the fitted PipelineModel), ``manifest/``
(one JSON row), ``metrics/``, ``parity/``. Readers accept the feature-list
aliases of both front ends of the reference.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
# Names under which a manifest may list the model's inputs.
FEATURE_ALIASES = ("features", "inputs", "input_features", "X_features", "X_cols")

MANIFEST_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("artifact_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("random_state", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("profile", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("label_type", T.StringType()),
    T.StructField("input_types", T.StringType()),
    T.StructField("data_path", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("split", T.StringType()),
])


def save_manifest(spark: SparkSession, run_dir: str, fitted, seed: int, data_path: str | None = None,
                  split: dict | None = None) -> dict:
    """A6 write: one JSON row describing the run. ``split`` (method, test_size and
    key) is how its rows were split. A run writes its manifest last."""
    m = {
        "schema_version": SCHEMA_VERSION, "artifact_type": "model", "model": fitted.kind,
        "task": fitted.task, "target": fitted.target, "features": list(fitted.inputs),
        "random_state": int(seed), "timestamp": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "profile": fitted.params.get("profile", "core"),
        "labels": [str(v) for v in fitted.labels] if fitted.labels else None,
        "label_type": fitted.label_type, "input_types": json.dumps(fitted.input_types),
        "data_path": data_path,
        "params": json.dumps({k: v for k, v in fitted.params.items()
                              if isinstance(v, (int, float, str, bool)) or v is None}),
        "split": json.dumps(split) if split else None,
    }
    spark.createDataFrame([m], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{run_dir}/manifest")
    return m


def read_manifests(spark: SparkSession, pattern) -> DataFrame:
    """A6 read: manifests as a table; the feature list is the first present
    of the known aliases. Malformed files give partial rows (PERMISSIVE)."""
    raw = spark.read.option("mode", "PERMISSIVE").json(pattern)
    have = set(raw.columns)
    feats = [F.col(a) for a in FEATURE_ALIASES if a in have]
    out = raw.withColumn("features", F.coalesce(*feats) if feats else F.lit(None).cast("array<string>"))
    return out.withColumn("source_file", F.col("_metadata.file_path"))


def load_manifest(spark: SparkSession, run_dir: str) -> dict:
    row = read_manifests(spark, f"{run_dir}/manifest").first()
    return row.asDict(recursive=True)


def save_model(fitted, run_dir: str) -> str:
    """A7 write. A kNN model also writes its standardised training rows."""
    fitted.pipeline.write().overwrite().save(f"{run_dir}/model")
    knn = getattr(fitted, "knn", None)
    if knn is not None:
        knn.reference.write.mode("overwrite").parquet(f"{run_dir}/knn_reference")
    return f"{run_dir}/model"


def load_model(spark: SparkSession, run_dir: str):
    """A7 read: the pipeline and its manifest as a FittedModel."""
    from quarry.operators.models import FittedModel
    m = load_manifest(spark, run_dir)
    pm = PipelineModel.load(f"{run_dir}/model")
    labels = m.get("labels")
    params = json.loads(m.get("params") or "{}")
    params.setdefault("profile", m.get("profile"))
    args = (pm, m["task"], m["model"], m["target"], list(m["features"] or []), labels,
            m.get("label_type"), params, json.loads(m.get("input_types") or "{}"))
    if m["model"] == "knn":
        from quarry.operators.knn import KnnModel
        from quarry.operators.models import KnnFitted
        ref = spark.read.parquet(f"{run_dir}/knn_reference")
        return KnnFitted(*args, knn=KnnModel(pm, ref, int(params["k"]), m["task"], int(params["d"])))
    return FittedModel(*args)


def run_names(spark: SparkSession, root: str) -> list[str]:
    """Sub-folders of ``root`` (none if it does not exist), through the file
    system that the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory())


def _has(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_data(spark: SparkSession, run_dir: str) -> DataFrame:
    """The table that a run was trained on, from its manifest."""
    from quarry.sources.tables import read_table
    path = load_manifest(spark, run_dir).get("data_path")
    if not path:
        raise ValueError(f"the manifest of {run_dir} names no data_path; give the table")
    return read_table(spark, path)


def parity_of(spark: SparkSession, run_dir: str, key: str | None = None) -> DataFrame:
    """F6 of a saved run: its parity table, or, where that is missing, the model's
    predictions on its training table, split as the manifest says (a run that does
    not say: 20 % by ``key``, stratified for classes)."""
    if _has(spark, f"{run_dir}/parity"):
        return spark.read.parquet(f"{run_dir}/parity").select("actual", "predicted", "split")
    from quarry.operators.evaluate import parity
    from quarry.operators.split import split_train_test
    fitted, m = load_model(spark, run_dir), load_manifest(spark, run_dir)
    data = run_data(spark, run_dir).dropna(how="any", subset=[*fitted.inputs, fitted.target])
    how = json.loads(m.get("split") or "{}")
    method = how.get("method") or ("stratified" if fitted.task == "classification" else "random")
    key = how.get("key") or key
    if key is None:
        raise ValueError(f"the manifest of {run_dir} names no key column; give one")
    parts = split_train_test(data, method, how.get("test_size", 0.2), m["random_state"], key=key, stratify_col=fitted.target)
    scored = fitted.transform(parts)
    return parity(scored.where("split = 'train'"), scored.where("split = 'test'"), fitted.target, fitted.pred_col)


def list_runs(spark: SparkSession, root: str, committed: bool = False) -> DataFrame:
    """One row per run folder under ``root``: its manifest joined to
    its ``test`` metrics row (split matched case-insensitively), sorted by
    name. A missing or broken manifest or metrics file leaves NULLs; a root
    without runs, or none at all, gives no row. With ``committed`` only runs are
    listed whose manifest, the last thing a run writes, was written to its end."""
    root = root.rstrip("/")
    names = run_names(spark, root)
    if committed:
        names = [n for n in names if _has(spark, f"{root}/{n}/manifest/_SUCCESS")]
    out = spark.createDataFrame([(n,) for n in names], "name string")
    nth = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    kept = [n for n in names if _has(spark, f"{root}/{n}/manifest")]
    cols = [f for f in MANIFEST_SCHEMA.fieldNames()]
    if kept:
        man = read_manifests(spark, [f"{root}/{n}/manifest" for n in kept]).withColumn("name", nth)
        man = man.select("name", *[(F.col(c) if c in man.columns else F.lit(None).cast(MANIFEST_SCHEMA[c].dataType)).alias(c) for c in cols],
                         "source_file").dropDuplicates(["name"])
        out = out.join(man, "name", "left")
    else:
        out = out.select("name", *[F.lit(None).cast(MANIFEST_SCHEMA[c].dataType).alias(c) for c in cols],
                         F.lit(None).cast("string").alias("source_file"))
    kept = [n for n in names if _has(spark, f"{root}/{n}/metrics")]
    if kept:
        met = spark.read.option("mode", "PERMISSIVE").json([f"{root}/{n}/metrics" for n in kept])
        if "split" in met.columns:
            met = met.withColumn("name", nth).where(F.lower("split") == "test").drop("split", "_corrupt_record")
            out = out.join(met, "name", "left")
    return out.orderBy("name")


def combine_scores(tables: dict, order=None) -> DataFrame:
    """A10: full outer merge of per-metric (feature, score) tables on
    ``feature``; one column per metric in the requested order; sorted by
    feature."""
    order = list(order or tables)
    out = None
    for m in order:
        t = tables[m].select("feature", F.col("score").alias(m))
        out = t if out is None else out.join(t, "feature", "full")
    return out.select("feature", *order).orderBy("feature")
