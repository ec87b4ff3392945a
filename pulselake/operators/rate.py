"""Per-second increase of a counter over a trailing range, as in ``rate(value[5m])``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.times import div
from pulselake.operators.series import NANOS


def rate(
    points: DataFrame,
    range_seconds: int = 300,
    by: tuple[str, ...] = ("series_key",),
    tie: str = "value",
    segment_seconds: int | None = None,
    out: str = "rate",
) -> DataFrame:
    """For each point: the increase since the first point of ``[t - range, t]``, divided by the range.

    A fall of the counter counts as a reset: the increase is then the new value.

    A point needs only the points of its range. Each series is therefore cut into segments of time, and
    the last ``range_seconds`` of a segment are copied into the next one. A series of any size is spread
    over its segments, one shuffle moves the rows, and every step inside a segment is one ordered pass:
    the increases are summed up going forward; going backward, a probe at ``t - range`` meets the sum as it
    stood at the first point in range. No frame is read once per row. Short segments spread a series wider
    and copy more of it: the default, four ranges, copies a quarter.
    """
    segment_seconds = segment_seconds or 4 * range_seconds
    if segment_seconds < range_seconds:
        raise ValueError("a segment must be at least as long as the range")
    reach, length = range_seconds * NANOS, segment_seconds * NANOS
    at = F.col("time_unix_nano")
    home = div(at, length)
    spread = points.select(
        "*",
        F.explode(F.sequence(home, div(at + reach, length))).alias("_segment"),
    ).withColumn("_own", F.col("_segment") == home)

    key = [F.col(c) for c in by] + [F.col("_segment")]
    forward = Window.partitionBy(*key).orderBy("time_unix_nano", tie)
    before = F.lag("value").over(forward)
    step = (
        F.when(before.isNull(), F.lit(0.0))
        .when(F.col("value") < before, F.col("value"))
        .otherwise(F.col("value") - before)
    )
    summed = spread.withColumn("_step", step).withColumn(
        "_total", F.sum("_step").over(forward.rowsBetween(Window.unboundedPreceding, 0))
    )

    # Role 0 is the point, role 1 its probe; copies from the segment before need no probe.
    roles = F.when(F.col("_own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    probes = summed.select("*", F.explode(roles).alias("_role")).withColumn(
        "_at", F.when(F.col("_role") == 1, at - reach).otherwise(at)
    )
    # Going backward, a point at the probe's own time comes before the probe: the range is closed.
    backward = (
        Window.partitionBy(*key)
        .orderBy(F.desc("_at"), F.asc("_role"), F.desc(tie))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    first = F.last(F.when(F.col("_role") == 0, F.col("_total")), ignorenulls=True).over(backward)
    return (
        probes.withColumn("_first", first)
        .where(F.col("_role") == 1)
        .withColumn(out, (F.col("_total") - F.col("_first")) / F.lit(float(range_seconds)))
        .drop("_segment", "_own", "_step", "_total", "_role", "_at", "_first")
    )
