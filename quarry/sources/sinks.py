"""Sinks (A3-A5, A8): score, parity, metric and prediction tables.

All writes are DataFrame writes with ``mode('overwrite')``: re-running a
job after a lost executor or a failed attempt replaces its output instead
of duplicating it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


def output_root(spark: SparkSession) -> str:
    """Shared folder for job outputs: ``spark.quarry.outputDir`` when set,
    else a folder next to the checkpoints (shared by the whole cluster)."""
    root = spark.conf.get("spark.quarry.outputDir", None)
    if root:
        return root.rstrip("/")
    return checkpoint_dir(spark).rstrip("/") + "/quarry-out"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{output_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _write(df: DataFrame, path: str, fmt: str, partition_by=None, one_partition: bool = False):
    w = df.write.mode("overwrite")
    if one_partition:
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def write_scores(scores: DataFrame, out: str, layout: str = "long", fmt: str = "csv") -> str:
    """A3: ``long`` (metric, feature, score), ``wide`` (feature, one column
    per metric, combined), or ``per_metric`` (feature, score in one folder
    per metric)."""
    if layout == "long":
        cols = [c for c in ("metric", "feature", "score", "rank") if c in scores.columns]
        return _write(scores.select(*cols), f"{out}/scores_long", fmt)
    if layout == "wide":
        return _write(scores, f"{out}/scores_wide", fmt)
    if layout == "per_metric":
        return _write(scores.select("metric", "feature", "score"), f"{out}/scores_by_metric", fmt,
                      partition_by="metric")
    raise ValueError("layout must be long, wide or per_metric")


def write_parity(parity: DataFrame, run_dir: str, fmt: str = "parquet", extra: str | None = None) -> str:
    """A4: the parity table partitioned by split (train / test) under
    ``parity``, and the union with its split as a column under ``parity_all``;
    optionally a second copy of the first at ``extra``."""
    _write(parity, f"{run_dir}/parity", fmt, partition_by="split")
    _write(parity.select("actual", "predicted", "split"), f"{run_dir}/parity_all", fmt)
    if extra:
        _write(parity, extra, fmt, partition_by="split")
    return f"{run_dir}/parity"


def write_metrics(metrics: DataFrame, run_dir: str, fmt: str = "json") -> str:
    """A5: one row per split (a handful of rows, so one file)."""
    return _write(metrics.coalesce(1), f"{run_dir}/metrics", fmt)


def write_predictions(pred: DataFrame, out: str, run_id: str | None = None, fmt: str = "parquet") -> str:
    """Predictions; the run id becomes a partition column, so several scoring
    runs share one table. A run's rows replace those of the same run alone; they
    appear when the write is committed."""
    if run_id:
        pred = pred.withColumn("run_id", F.lit(run_id))
        return _write(pred, out, fmt, partition_by="run_id", one_partition=True)
    return _write(pred, out, fmt)
