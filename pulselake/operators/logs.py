"""Log rows: search, level filter, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.aggregates import error_rate
from pulselake.functions.labels import drop_labels
from pulselake.functions.text import log_text


def at_level(logs: DataFrame, level: str) -> DataFrame:
    """Rows of one level; a plain column, so the filter reaches the parquet reader."""
    return logs.where(F.col("level") == level)


def search(logs: DataFrame, text: str | None) -> DataFrame:
    """Rows whose message or a label value contains the text, case ignored."""
    return logs.where(log_text(text))


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def error_rates(logs: DataFrame, *by: str | Column, error: str = "ERROR") -> DataFrame:
    """Share of error rows, overall or per group."""
    return logs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), error_rate(error=error).alias("error_rate"))


def unpack_message(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """Takes the label ``message`` out of the label map into a column."""
    return rows.withColumn("message", F.coalesce(F.col(labels)["message"], F.lit(""))).withColumn(
        labels, drop_labels(F.col(labels), ["message"])
    )


def result_rows(logs: DataFrame) -> DataFrame:
    """The four fields a log query returns."""
    return logs.select("time_unix_nano", "ts", "level", "message", "labels")
