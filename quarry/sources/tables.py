"""A1 read_table and the driver's table set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
               infer: bool = True, multi_line: bool = False) -> DataFrame:
    """A1: a table from CSV (header, inferred or declared types), Parquet or
    JSON (one object per line; ``multi_line`` for one document per file). Inference costs an extra pass over CSV; pass ``schema`` in
    production and keep the inferred one in the run manifest."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet")
                  else "json" if path.endswith(".json") else "csv")
    if fmt == "csv":
        r = spark.read.option("header", True).option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", infer)
        return r.csv(path)
    if fmt == "json":
        r = spark.read.option("multiLine", multi_line)
        return (r.schema(schema) if schema is not None else r).json(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
