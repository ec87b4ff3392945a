"""Roll-ups of metric points: tables of mergeable states, from which coarser steps are read without the points.

A state stands for the points of a series in a bucket of time: count, sum, extremes, newest value and a sketch of the values.
States of one bucket, and of buckets of a coarser one, merge to what the points themselves would give: exactly, but for the order in which
doubles are added and for percentiles, whose rank is off by at most about 1.7 % (KLL sketch with k = 200; up to that many values
are kept as they are). So a table may hold several states of a bucket: late points just add theirs.

A query takes the coarsest table whose step divides the step asked for and both ends of the range.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.times import div, instant
from pulselake.operators.series import NANOS, with_series_key

STEPS = (60, 3600, 86_400)
SKETCH_K = 200
STATE = "n bigint, total double, least double, greatest double, newest double, newest_at bigint, sketch binary"


def _bucket(seconds: Column, step: int) -> Column:
    return F.timestamp_seconds(div(seconds, step) * step).alias("bucket")


def states(points: DataFrame, step: int, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """A state of each series and bucket of ``step`` seconds; points without a value take no part."""
    source = (with_series_key(points) if "series_key" in by else points).where(F.col("value").isNotNull())
    value, at = F.col("value").cast("double"), F.col("time_unix_nano")
    return source.groupBy(*by, _bucket(div(at, NANOS), step)).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.max_by(value, at).alias("newest"), F.max(at).alias("newest_at"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"),
    )


def merged(rows: DataFrame, step: int, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """States of buckets of ``step`` seconds from states of finer ones, or from several of the same."""
    return rows.groupBy(*by, _bucket(F.unix_seconds("bucket"), step)).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.max_by("newest", "newest_at").alias("newest"), F.max("newest_at").alias("newest_at"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
    )


def _table(path: str, step: int) -> str:
    return f"{path.rstrip('/')}/step_{step}"


def write_rollups(points: DataFrame, path: str, batch: str, steps: tuple[int, ...] = STEPS, by: tuple[str, ...] = ("series_key",)) -> None:
    """Add the states of these points to the roll-up tables; each table is made from the one before.

    A batch lands in partitions of its name and replaces them when it is repeated.
    """
    steps = tuple(sorted(steps))
    if any(b % a for a, b in zip(steps, steps[1:])):
        raise ValueError(f"each of the steps {steps} must divide the next")
    spark, finer = points.sparkSession, None
    for step in steps:
        rows = states(points, step, by) if finer is None else merged(finer, step, by)
        dated = rows.withColumns({"dt": F.col("bucket").cast("date"), "batch": F.lit(batch)})
        laid = dated.hint("rebalance", "dt").sortWithinPartitions("dt", *by, "bucket")
        laid.write.partitionBy("dt", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(_table(path, step))
        finer = read_states(spark, path, step, by).where(F.col("batch") == batch)


def read_states(spark: SparkSession, path: str, step: int, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    keys = ", ".join(f"{c} string" for c in by)
    return spark.read.schema(f"{keys}, bucket timestamp, {STATE}, dt date, batch string").parquet(_table(path, step))


def table_step(step: int, start: datetime, end: datetime, steps: tuple[int, ...] = STEPS) -> int:
    """The coarsest step of a table from which buckets of ``step`` seconds in the range can be made."""
    ends = [start.timestamp(), end.timestamp()]
    fits = [s for s in steps if step % s == 0 and all(e % s == 0 for e in ends)]
    if not fits:
        raise ValueError(f"no roll-up of {sorted(steps)} s divides a step of {step} s from {start} to {end}")
    return max(fits)


def rolled(
    spark: SparkSession, path: str, step: int, start: datetime | str, end: datetime | str,
    percents: tuple[float, ...] = (), steps: tuple[int, ...] = STEPS, by: tuple[str, ...] = ("series_key",),
) -> DataFrame:
    """count, sum, avg, min, max, latest and percentiles (``p95``) of each series and step in ``[start, end)``."""
    start, end = instant(start), instant(end)
    table = read_states(spark, path, table_step(step, start, end, steps), by)
    days = table.where((F.col("dt") >= F.lit(start.date())) & (F.col("dt") <= F.lit(end.date())))
    found = merged(days.where((F.col("bucket") >= F.lit(start)) & (F.col("bucket") < F.lit(end))), step, by)
    wanted = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias(f"p{p:g}") for p in percents]
    return found.select(
        *by, "bucket", F.col("n").alias("count"), F.col("total").alias("sum"), (F.col("total") / F.col("n")).alias("avg"),
        F.col("least").alias("min"), F.col("greatest").alias("max"), F.col("newest").alias("latest"), *wanted,
    )
