"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

# One Arrow batch holds at most this many rows and bytes, so a table of very
# long documents cannot fill a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20
MARK_BITS = 1 << 25


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: it is
    computed once, and a lost executor does not lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_by_id(df: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """``df.mapInPandas(run, "<key> long, <schema>")`` whose integer key travels as
    text: beside a null, pandas would turn integers into inexact floats."""
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast("long"))


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """``pdf`` with its strings as Python objects: a group that came in several
    batches has chunked string columns, which cannot be returned as they are."""
    return pdf.astype({c: object for c, kind in pdf.dtypes.items() if isinstance(kind, pd.StringDtype)})


def mark(df: DataFrame, name: str, rows: DataFrame, column: str) -> DataFrame:
    """``df`` and a boolean ``marked``: true for every row whose ``name`` is among the
    values of ``column`` in ``rows`` (and for few others, as long as those values are
    fewer than the bits). The values' hashes set bits of one bitmap of ``MARK_BITS``
    bits; its words, a fixed number of rows at most, are broadcast."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS))
    words = (rows.select(bit(column).alias("b"))
             .select((F.col("b") / 64).cast("int").alias("__w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("x"))
             .groupBy("__w").agg(F.bit_or("x").alias("__x")))
    out = df.withColumn("__b", bit(name)).withColumn("__w", (F.col("__b") / 64).cast("int")).join(F.broadcast(words), "__w", "left")
    found = F.coalesce(F.getbit("__x", (F.col("__b") % 64).cast("int")) == 1, F.lit(False))
    return out.withColumn("marked", found).drop("__b", "__w", "__x")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes (none for null).
    ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
