"""Metric series: grouping, statistics, latest values, matrix form, first points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.aggregates import latest, named_aggregates
from pulselake.functions.labels import series_key, series_labels
from pulselake.functions.times import div

NANOS = 1_000_000_000


def with_series_key(points: DataFrame) -> DataFrame:
    """Adds the canonical series key where the table does not carry it."""
    if "series_key" in points.columns:
        return points
    return points.withColumn("series_key", series_key(F.col("labels")))


def label_stats(points: DataFrame, *by: str) -> DataFrame:
    """count(value), sum(value), min(ts), max(ts) per label column."""
    return points.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.sum("value").alias("sum_value"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def series(points: DataFrame) -> DataFrame:
    """One row per label set: the labels and the number of points.

    Only the key is shuffled; the labels are read back from it afterwards.
    """
    return (
        with_series_key(points)
        .groupBy("series_key")
        .agg(F.count(F.lit(1)).alias("points"))
        .withColumn("labels", series_labels(F.col("series_key")))
    )


def series_stats(points: DataFrame, names: list[str]) -> DataFrame:
    """The named aggregates of each series."""
    return with_series_key(points).groupBy("series_key").agg(*named_aggregates(names))


def latest_values(points: DataFrame, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """The newest value of each series."""
    return with_series_key(points).groupBy(*by).agg(latest().alias("latest"))


def above_threshold(points: DataFrame, threshold: float) -> DataFrame:
    """Series whose newest value is greater than the threshold."""
    return latest_values(points).where(F.col("latest") > threshold)


def summary(points: DataFrame, value: str = "value") -> DataFrame:
    """Total, average, smallest and greatest value."""
    v = F.col(value)
    return points.agg(
        F.sum(v).alias("total"), F.avg(v).alias("average"), F.min(v).alias("smallest"), F.max(v).alias("greatest")
    )


def first_per_series(points: DataFrame, n: int, tie: list[str] | None = None) -> DataFrame:
    """The earliest ``n`` points of each series.

    ``row_number() <= n`` lets Spark cut each map task's share to ``n`` rows per series before the
    shuffle, so a series with most of the rows costs one task no more than any other.
    """
    order = [F.col("time_unix_nano"), *map(F.col, tie or ["value"])]
    window = Window.partitionBy("series_key").orderBy(*order)
    return (
        with_series_key(points)
        .withColumn("position", F.row_number().over(window))
        .where(F.col("position") <= n)
    )


CHUNK_SECONDS = 600


def matrix(points: DataFrame, chunk_seconds: int | None = CHUNK_SECONDS, max_values: int = 10_000, by: str = "series_key") -> DataFrame:
    """Series as arrays of ``(unix seconds, value)``, each array one stretch of time.

    A series is cut at whole ``chunk_seconds``, and a stretch with more than ``max_values`` points goes on
    in further parts, so no array and no task holds a whole series. One shuffle, on (series, stretch); a
    stretch is ordered on disk where it does not fit memory. The busier a series, the shorter the stretches
    should be. ``None`` makes one stretch of the whole time, for points already limited in number.
    """
    length = chunk_seconds or 0
    start = div(F.col("time_unix_nano"), length * NANOS) * length if length else F.lit(0).cast("bigint")
    order = Window.partitionBy(by, "chunk_start").orderBy("time_unix_nano", "value")
    rows = (
        with_series_key(points)
        .select(by, "time_unix_nano", "value", start.alias("chunk_start"))
        .withColumn("part", div(F.row_number().over(order) - 1, max_values).cast("int"))
    )
    value = F.struct(
        F.col("time_unix_nano"),
        div(F.col("time_unix_nano"), NANOS).cast("double").alias("unix_seconds"),
        F.col("value"),
    )
    return (
        rows.groupBy(by, "chunk_start", "part")
        .agg(F.array_sort(F.collect_list(value)).alias("sorted"))
        .select(
            by,
            "chunk_start",
            "part",
            F.transform("sorted", lambda p: F.struct(p["unix_seconds"].alias("unix_seconds"), p["value"].alias("value")))
            .alias("values"),
        )
    )


def downsample(
    points: DataFrame,
    step_seconds: int,
    aggregates: list[Column] | None = None,
    by: tuple[str, ...] = ("series_key",),
) -> DataFrame:
    """Aggregates per series and step of time; partial sums are made before the shuffle."""
    step = step_seconds * NANOS
    source = with_series_key(points) if "series_key" in by else points
    bucket = F.timestamp_seconds(div(F.col("time_unix_nano"), step) * step_seconds)
    return source.groupBy(*by, bucket.alias("bucket")).agg(
        *(aggregates or named_aggregates(["avg", "min", "max", "sum", "count"]))
    )
