"""The three queries of the system, end to end, and panel dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.text import trace_text
from pulselake.functions.times import duration_seconds, in_range, query_range
from pulselake.operators.logs import result_rows, search
from pulselake.operators.panels import Panel, log_table_rows, panel_range, trace_table_rows
from pulselake.operators.series import CHUNK_SECONDS, downsample, matrix, with_series_key
from pulselake.operators.traces import nested_spans, newest_traces, spans, spans_of, traces
from pulselake.sources.tables import where_labels

# The usual limits of the three queries. No query applies them unless it is asked to.
METRIC_LIMIT = 1000
LOG_LIMIT = 100
TRACE_LIMIT = 100


def earliest(df: DataFrame, limit: int | None, tie: list[str]) -> DataFrame:
    """The first rows by time; 0 or None keeps all. Filters come before, never after, the limit."""
    ordered = df.orderBy("time_unix_nano", *tie)
    return ordered.limit(limit) if limit else ordered


def metric_points(
    points: DataFrame,
    labels: dict[str, str] | str = "",
    start=None,
    end=None,
    limit: int | None = None,
    now=None,
    where: Column | None = None,
) -> DataFrame:
    """Points of a label selector and range, the earliest ``limit`` of them."""
    rows = in_range(points, *query_range(start, end, now))
    if labels:
        rows = where_labels(rows, "metrics", labels)
    if where is not None:
        rows = rows.where(where)
    rows = with_series_key(rows)
    return earliest(rows, limit, ["series_key", "value"]) if limit else rows


def metric_query(
    points: DataFrame,
    labels: dict[str, str] | str = "",
    start=None,
    end=None,
    step: str | None = None,
    limit: int | None = None,
    now=None,
    chunk_seconds: int | None = CHUNK_SECONDS,
) -> DataFrame:
    """Matrix of a metric query. With ``step`` each series is averaged per step before the limit counts.

    A series comes in stretches of ``chunk_seconds``, or as one array if that is None: for results of known size.
    """
    if not step:
        return matrix(metric_points(points, labels, start, end, limit, now), chunk_seconds=chunk_seconds)
    step_seconds = int(duration_seconds(step))
    if step_seconds < 1:
        raise ValueError(f"step below one second: {step!r}")
    stepped = downsample(
        metric_points(points, labels, start, end, None, now), step_seconds, [F.avg("value").alias("value")]
    ).select("series_key", (F.unix_micros("bucket") * 1000).alias("time_unix_nano"), "value")
    return matrix(earliest(stepped, limit, ["series_key", "value"]) if limit else stepped, chunk_seconds=chunk_seconds)


def log_query(
    logs: DataFrame,
    text: str = "",
    start=None,
    end=None,
    limit: int | None = None,
    level: str | None = None,
    now=None,
    where: Column | None = None,
) -> DataFrame:
    """Log rows with a text in a range, the earliest ``limit`` of them."""
    rows = in_range(logs, *query_range(start, end, now))
    if level:
        rows = rows.where(F.col("level") == level)
    if where is not None:
        rows = rows.where(where)
    return earliest(result_rows(search(rows, text)), limit, ["level", "message"])


def matching_span_points(points: DataFrame, text: str, whole_trace: bool = False) -> DataFrame:
    """Span points with a text in their ids or names, or all points of such traces."""
    hits = points.where(trace_text(text))
    if not (text and whole_trace):
        return hits
    return points.join(hits.select("trace_id").distinct(), "trace_id", "left_semi")


def trace_query(
    points: DataFrame,
    text: str = "",
    start=None,
    end=None,
    limit: int | None = None,
    whole_trace: bool = False,
    now=None,
) -> DataFrame:
    """Traces with a text in a range, newest first."""
    rows = matching_span_points(in_range(points, *query_range(start, end, now)), text, whole_trace)
    return newest_traces(traces(spans(rows)), limit)


def trace_details(
    points: DataFrame,
    text: str = "",
    start=None,
    end=None,
    limit: int | None = None,
    whole_trace: bool = False,
    now=None,
) -> DataFrame:
    """As ``trace_query`` with the spans of each trace as arrays, a trace with very many in several rows."""
    rows = matching_span_points(in_range(points, *query_range(start, end, now)), text, whole_trace)
    newest = newest_traces(traces(spans(rows)), limit)
    return newest.join(nested_spans(spans_of(rows, newest), newest), "trace_id")


def panel_rows(tables: dict[str, DataFrame], panel: Panel, now) -> DataFrame:
    """The rows a panel shows: points for a metric panel, (ts, text) rows for logs and traces."""
    start, end = panel_range(panel, now)
    source = panel.data_source
    if source == "metrics":
        return metric_points(tables[source], panel.query, start, end, panel.max_rows)
    if source == "logs":
        return log_table_rows(log_query(tables[source], panel.query, start, end, panel.max_rows))
    if source == "traces":
        return trace_table_rows(trace_query(tables[source], panel.query, start, end, panel.max_rows))
    raise ValueError(f"unsupported data source: {source}")


def result_json(rows: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text, for a JSON sink."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(out))
