"""Continuous downsampling of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.aggregates import named_aggregates
from pulselake.operators.series import with_series_key


def downsample_stream(
    points: DataFrame, step: str, delay: str = "10 minutes", by: tuple[str, ...] = ("series_key",),
    aggregates: list[Column] | None = None,
) -> DataFrame:
    """Aggregates per series and step, each emitted once, when the watermark has passed its end."""
    source = with_series_key(points) if "series_key" in by else points
    window = F.window("ts", step).alias("window")
    found = (
        source.withWatermark("ts", delay)
        .groupBy(window, *by)
        .agg(*(aggregates or named_aggregates(["avg", "min", "max", "sum", "count"])))
    )
    return found.select(F.col("window.start").alias("bucket"), *[c for c in found.columns if c != "window"])
