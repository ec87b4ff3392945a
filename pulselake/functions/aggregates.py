"""Named aggregates: each returns one aggregate Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The aggregate names a configuration may list.
NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def named_aggregates(names: list[str], value: str = "value") -> list[Column]:
    unknown = [n for n in names if n not in NAMED]
    if unknown:
        raise ValueError(f"unknown aggregates: {unknown}")
    return [NAMED[n](F.col(value)).alias(n) for n in names]


def error_rate(level: str = "level", error: str = "ERROR") -> Column:
    """Share of rows at the error level."""
    return F.count_if(F.col(level) == error) / F.count(F.lit(1))


def latest(value: str = "value", at: str = "time_unix_nano") -> Column:
    """Value at the greatest time. Of several values at that very instant it may be any one.

    Number and time are held as plain aggregation buffers, so Spark hashes instead of sorting its input;
    a struct buffer, which could order such values, takes two to three times as long.
    """
    return F.max_by(value, at)


def percentile_estimate(percent: float, value: str = "value", accuracy: int = 10_000) -> Column:
    """Percentile from a bounded sketch: one pass, rank error at most 1/accuracy."""
    return F.percentile_approx(F.col(value), F.lit(percent / 100.0), F.lit(accuracy))
