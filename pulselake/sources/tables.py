"""Scans of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.labels import label_match
from pulselake.functions.times import in_range, instant, store_range
from pulselake.schemas import TABLES

# Labels held in plain columns: a filter on these reaches the parquet reader, one on the map does not.
PROMOTED = {
    "metrics": {"__name__": "name", "service.name": "service"},
    "logs": {"service.name": "service"},
    "traces": {
        "service.name": "service",
        "trace.id": "trace_id",
        "span.id": "span_id",
        "parent.span.id": "parent_span_id",
        "span.name": "span_name",
        "span.kind": "span_kind",
    },
}


def read_table(spark: SparkSession, path: str, signal: str, start=None, end=None) -> DataFrame:
    """A telemetry table written by ``pulselake.sinks.tables`` with its fixed schema (no inference).

    With a range the rows are those of its days, to be cut to the range by ``scan``: the filter on the day prunes
    the folders that are read, however long the range.
    """
    rows = spark.read.schema(TABLES[signal]).parquet(path)
    if start is not None:
        rows = rows.where(F.col("dt") >= F.lit(instant(start).date()))
    if end is not None:
        rows = rows.where(F.col("dt") <= F.lit(instant(end).date()))
    return rows


def scan(df: DataFrame, start=None, end=None, now=None) -> DataFrame:
    """Rows of ``[start, end]``; an empty start is the epoch, an empty end is now."""
    return in_range(df, *store_range(start, end, now))


def where_labels(df: DataFrame, signal: str, wanted: dict[str, str] | str) -> DataFrame:
    """Rows with these label values, by promoted column where there is one."""
    promoted = {k: c for k, c in PROMOTED[signal].items() if c in df.columns}
    return df.where(label_match(wanted, promoted=promoted))
