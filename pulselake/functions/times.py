"""Instants, ranges and durations.

Nanoseconds are the exact time of every row (``time_unix_nano``); Spark timestamps hold microseconds, so
``ts`` is derived from them and used for pruning and display.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DEFAULT_SPAN = timedelta(hours=1)

# Seconds per unit of a duration text such as "1h30m" or "30d".
UNIT_SECONDS = {
    "ns": 1e-9,
    "us": 1e-6,
    "µs": 1e-6,
    "ms": 1e-3,
    "s": 1.0,
    "m": 60.0,
    "h": 3600.0,
}


def duration_seconds(text: str) -> float:
    """Seconds of a duration text: unit parts (``1h30m``, ``250ms``) or whole days (``30d``)."""
    days = re.fullmatch(r"(\d+)d", text)
    if days:
        return int(days.group(1)) * 86400.0
    if text in ("0", "+0", "-0"):
        return 0.0
    body = text[1:] if text[:1] in ("+", "-") else text
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"bad duration: {text!r}")
    total = sum(float(n) * UNIT_SECONDS[u] for n, u in parts)
    return -total if text.startswith("-") else total


def instant(value: str | datetime) -> datetime:
    """A UTC instant from an RFC 3339 text or a datetime (without a zone: UTC)."""
    if isinstance(value, str):
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", value):
            raise ValueError(f"not an RFC 3339 time: {value!r}")
        value = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def unix_nanos(value: str | datetime) -> int:
    delta = instant(value) - EPOCH
    micros = (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    nanos = 0
    if isinstance(value, str):
        fraction = re.search(r"\.(\d+)", value)
        if fraction:
            nanos = int(fraction.group(1)[6:9].ljust(3, "0"))
    return micros * 1000 + nanos


def query_range(start=None, end=None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The range of a query: an empty start means one hour ago, an empty end means now."""
    now = instant(now) if now is not None else datetime.now(timezone.utc)
    return (
        instant(start) if start else now - DEFAULT_SPAN,
        instant(end) if end else now,
    )


def store_range(start=None, end=None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The range of a table scan: an empty start means the epoch, an empty end means now."""
    now = instant(now) if now is not None else datetime.now(timezone.utc)
    return instant(start) if start else EPOCH, instant(end) if end else now


def _ts_text(value: datetime) -> Column:
    # A text literal takes the type of the column it is compared with (with or without a zone), so the
    # comparison keeps the bare column on its left and reaches the parquet reader.
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f") + "Z")


def between_ts(start=None, end=None, column: str | Column = "ts", strict: bool = False) -> Column:
    """Rows of the range by timestamp, both ends included (``strict``: both excluded)."""
    col = F.col(column) if isinstance(column, str) else column
    test = F.lit(True)
    if start is not None:
        low = _ts_text(instant(start))
        test = (col > low) if strict else (col >= low)
    if end is not None:
        high = _ts_text(instant(end))
        upper = (col < high) if strict else (col <= high)
        test = upper if start is None else test & upper
    return test


def between_nanos(start=None, end=None, column: str = "time_unix_nano", strict: bool = False) -> Column:
    """As ``between_ts`` on exact nanoseconds."""
    col = F.col(column)
    test = F.lit(True)
    if start is not None:
        low = F.lit(unix_nanos(start))
        test = (col > low) if strict else (col >= low)
    if end is not None:
        high = F.lit(unix_nanos(end))
        upper = (col < high) if strict else (col <= high)
        test = upper if start is None else test & upper
    return test


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of ``[start, end]``: partitions by ``dt``, row groups by ``ts``, rows by nanoseconds."""
    out = df
    if "dt" in df.columns:
        if start is not None:
            out = out.where(F.col("dt") >= F.lit(instant(start).date()))
        if end is not None:
            out = out.where(F.col("dt") <= F.lit(instant(end).date()))
    if "ts" in df.columns:
        out = out.where(between_ts(start, end))
    return out.where(between_nanos(start, end))


def ts_of_nanos(nanos: Column) -> Column:
    """Timestamp of integer nanoseconds, rounded down to microseconds."""
    # '/' would go through DOUBLE and lose digits; the remainder is taken off first, so div is exact.
    return F.call_function("timestamp_micros", F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000)))


def nanos_of_ts(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient of two integers, without a detour through DOUBLE."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
