"""G1 on a stream: a fitted pipeline is a stateless per-row map, so the same
``transform`` scores a streaming DataFrame. Files arriving in a folder are
scored micro-batch by micro-batch into a sink; the checkpoint location
makes the query restartable after a failure (exactly-once file sink)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def score_stream(spark: SparkSession, fitted, source_dir: str, schema, sink_dir: str,
                 checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start (and, with ``available_now``, finish) a streaming scoring query
    from ``source_dir`` to ``sink_dir``. Returns the StreamingQuery."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = r.load(source_dir)
    scored = fitted.transform(stream)
    w = scored.writeStream.format("parquet").option("path", sink_dir) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
