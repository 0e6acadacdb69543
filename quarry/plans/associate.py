"""Correlation job (3.1): read -> clean -> score -> rank -> shape -> write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import assoc
from quarry.sources.tables import load


def correlation_job(df: DataFrame, target: str, task: str = "regression",
                    metrics=("pearson", "spearman", "mi", "dcor"), inputs=None,
                    topk: int | None = None, sort_by: str = "combined", seed: int = 0,
                    out: str | None = None, fmt: str = "csv", key: str | None = None, mi_neighbors: int = 3,
                    dcor_sample: int | None = None):
    """The whole correlation run. Returns (long, wide, report) frames and,
    with ``out``, writes the score tables and the cleaning report there."""
    long, prep = assoc.associate(df, target, task, metrics, inputs=inputs, topk=topk, seed=seed, key=key,
                                 mi_neighbors=mi_neighbors, dcor_sample=dcor_sample)
    metrics = list(dict.fromkeys(m.lower() for m in metrics))
    wide = assoc.rank_wide(assoc.wide_table(long, metrics), sort_by, topk)
    report = prep.report()
    if out:
        from quarry.sources.sinks import write_scores
        write_scores(long, out, layout="long", fmt=fmt)
        write_scores(wide, out, layout="wide", fmt=fmt)
        report.coalesce(1).write.mode("overwrite").json(f"{out}/report")
    return long, wide, report


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lineitem, score l_quantity, l_discount and l_tax against
    l_extendedprice by Pearson and Spearman, and return the wide table with
    the combined score, strongest first."""
    _, wide, _ = correlation_job(load(spark, sf_dir, "lineitem"), "l_extendedprice", "regression",
                                 ["pearson", "spearman"], ["l_quantity", "l_discount", "l_tax"])
    return wide
