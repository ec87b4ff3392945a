"""Continuous ingest: request bodies to telemetry tables, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulselake.operators.flatten_logs import flatten_logs
from pulselake.operators.flatten_metrics import flatten_metrics
from pulselake.operators.flatten_spans import flatten_spans
from pulselake.sinks.tables import contract, writer
from pulselake.sources.otlp import parse, quarantine, well_formed

FLATTEN = {"metrics": flatten_metrics, "logs": flatten_logs, "traces": flatten_spans}
BATCH = "ingest_batch"
STREAM_ID = "sql.streaming.queryId"
FLUSH = "30 seconds"


def flatten(bodies: DataFrame, signal: str, column: str = "value", **options) -> DataFrame:
    """Table rows of request bodies, batch or stream."""
    return FLATTEN[signal](well_formed(parse(bodies, signal, column)), **options)


def stream_id(bodies: DataFrame) -> str:
    """Id of the stream a micro-batch comes from; it is kept with the checkpoint, so a restart has the same."""
    return bodies.sparkSession.sparkContext.getLocalProperty(STREAM_ID) or "batch"


def write_batch(bodies: DataFrame, batch_id: int, signal: str, path: str, rejected: str, column: str = "value") -> None:
    """One micro-batch: rows to ``path``, undecodable bodies to ``rejected``.

    Each lands in partitions named after the stream and the batch and replaces what is there, so a batch repeated
    after a failure leaves its rows once, and another stream, or one begun anew, only adds. A row whose time cannot be read is rejected too. Each body is parsed once
    for both tables.
    """
    parsed = parse(bodies, signal, column).persist()
    try:
        _store(parsed, f"{stream_id(bodies)}-{batch_id}", signal, path, rejected, column)
    finally:
        parsed.unpersist()


def _store(parsed: DataFrame, batch: str, signal: str, path: str, rejected: str, column: str) -> None:
    rows = FLATTEN[signal](well_formed(parsed))
    (
        writer(
            contract(rows.where(F.col("time_unix_nano").isNotNull()), signal).withColumn(BATCH, F.lit(batch)),
            signal,
            ("dt", BATCH),
        )
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    untimed = rows.where(F.col("time_unix_nano").isNull())
    bad = quarantine(parsed, column).unionByName(untimed.select(F.to_json(F.struct("*")).alias("body")))
    (
        bad.withColumn(BATCH, F.lit(batch))
        .write.partitionBy(BATCH)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(rejected)
    )


def start_ingest(
    bodies: DataFrame, signal: str, path: str, checkpoint: str, rejected: str | None = None,
    flush: str = FLUSH, available_now: bool = False, column: str = "value",
) -> StreamingQuery:
    """Starts the ingest of a stream of bodies; a batch is acknowledged once all its rows are stored.

    ``path`` and ``checkpoint`` must be in a folder all executors share.
    """
    rejected = rejected or f"{path.rstrip('/')}_rejected"
    query = bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: write_batch(df, batch_id, signal, path, rejected, column)
    )
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime=flush)).start()


def start_table(rows: DataFrame, path: str, checkpoint: str, flush: str = FLUSH, available_now: bool = False) -> StreamingQuery:
    """Appends a stream of table rows to parquet by day, exactly once by the sink's own log."""
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime=flush)).start()


def drop_repeats(rows: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Drops rows of a stream that repeat a key within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
