"""Spans and traces from span points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions.labels import span_labels
from pulselake.functions.text import has_identity
from pulselake.functions.values import STATUS_ERROR

SPAN_KEY = ["trace_id", "span_id"]


def spans(points: DataFrame) -> DataFrame:
    """One row per (trace, span): first-point attributes, time range, duration, status.

    Grouped on both ids, so map-side partial rows are shuffled and a trace id shared by very many points
    still spreads over its spans. Events are counted here and listed by ``span_events``.
    """
    # Points of one instant: duration before event before status, then by content. The labels are an
    # aggregate of their own, which Spark leaves out of the shuffle where they are not asked for.
    rank = F.when(F.col("point_type") == "duration", 0).when(F.col("point_type") == "event", 1).otherwise(2)
    first = F.struct(
        F.col("time_unix_nano"), rank.alias("rank"), F.col("span_name"), F.col("service"), F.col("span_kind"),
        F.col("parent_span_id"),
    )
    order = F.struct(first.alias("first"), F.col("event_name"), F.col("event_attr_key"), F.col("value"))
    return (
        points.where(has_identity())
        .groupBy(*SPAN_KEY)
        .agg(
            F.min(first).alias("first"),
            F.min_by("labels", order).alias("labels"),
            F.min("time_unix_nano").alias("start_unix_nano"),
            F.max("time_unix_nano").alias("end_unix_nano"),
            F.max("status_code").alias("status_code"),
            F.count("event_name").alias("event_count"),
            F.count(F.lit(1)).alias("point_count"),
        )
        .select(
            *SPAN_KEY,
            "first.parent_span_id",
            "first.span_name",
            "first.service",
            "first.span_kind",
            span_labels(F.col("labels")).alias("labels"),
            "start_unix_nano",
            "end_unix_nano",
            ((F.col("end_unix_nano") - F.col("start_unix_nano")) / F.lit(1e6)).alias("duration_ms"),
            "status_code",
            "event_count",
            "point_count",
        )
    )


def traces(span_rows: DataFrame) -> DataFrame:
    """One row per trace from its spans: name and service of the first point, range, duration, status.

    Spans are already reduced; of a trace with very many spans only partial rows reach its task.
    """
    return (
        span_rows.groupBy("trace_id")
        .agg(
            F.min(F.struct("start_unix_nano", "span_id", "span_name", "service")).alias("first"),
            F.min("start_unix_nano").alias("start_unix_nano"),
            F.max("end_unix_nano").alias("end_unix_nano"),
            F.max(F.when(F.col("status_code") == STATUS_ERROR, 1).otherwise(0)).alias("failed"),
            F.count(F.lit(1)).alias("span_count"),
        )
        .select(
            "trace_id",
            F.col("first.span_name").alias("name"),
            F.coalesce(F.nullif(F.col("first.service"), F.lit("")), F.lit("unknown")).alias("service"),
            "start_unix_nano",
            "end_unix_nano",
            ((F.col("end_unix_nano") - F.col("start_unix_nano")) / F.lit(1e6)).alias("duration_ms"),
            F.when(F.col("failed") == 1, "ERROR").otherwise("OK").alias("status"),
            "span_count",
        )
    )


def newest_traces(trace_rows: DataFrame, limit: int | None = 100) -> DataFrame:
    """The traces that started last, newest first; 0 or None keeps all."""
    ordered = trace_rows.orderBy(F.desc("start_unix_nano"), F.asc("trace_id"))
    return ordered.limit(limit) if limit else ordered


def span_events(points: DataFrame) -> DataFrame:
    """Event rows of spans: a filter, since each event point carries its span."""
    return points.where(has_identity() & F.col("event_name").isNotNull()).select(
        *SPAN_KEY,
        "time_unix_nano",
        "event_name",
        # Guarded, as a later filter on the map may be evaluated ahead of the one above.
        F.when(F.col("event_attr_key").isNotNull(), F.create_map("event_attr_key", "value")).alias("attributes"),
    )


def in_parts(rows: DataFrame, keys: list[str], counts: DataFrame, item, out: str, part_size: int) -> DataFrame:
    """Arrays of ``item`` per key, in parts of about ``part_size``.

    The number of parts of a key follows from its exact count, and a row's part from a hash of its item,
    so no array grows with the group. A key with up to ``part_size`` rows has one part.
    There may be as many keys as rows: Spark's estimate of rows made from text is too small, so broadcasting is ruled out.
    """
    parts = counts.select(*keys, F.ceil(F.col("_n") / F.lit(part_size)).alias("_parts")).hint("merge")
    placed = rows.join(parts, keys).select(*keys, item.alias("_item"), "_parts")
    return (
        placed.withColumn("part", F.pmod(F.xxhash64("_item"), F.col("_parts")).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list("_item")).alias(out))
    )


def spans_of(points: DataFrame, trace_rows: DataFrame) -> DataFrame:
    """The spans of the given traces.

    Points of other traces are dropped in the scan stage where the traces are few, as after a limit: Spark
    broadcasts their ids by its own size estimate, and only the wanted points are shuffled.
    """
    return spans(points.join(trace_rows.select("trace_id"), "trace_id", "left_semi"))


def nested_spans(span_rows: DataFrame, trace_rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """The spans of the given traces as arrays ``spans``, ordered by start, one row per trace and part."""
    item = F.struct(
        "start_unix_nano", "span_id", "parent_span_id", "span_name", "span_kind", "end_unix_nano", "duration_ms",
        F.coalesce("status_code", F.lit(0)).alias("status_code"), "event_count",
    )
    counts = trace_rows.select("trace_id", F.col("span_count").alias("_n"))
    return in_parts(span_rows, ["trace_id"], counts, item, "spans", part_size)


def nested_events(points: DataFrame, span_rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """The events of the given spans as arrays ``events``, ordered by time, one row per span and part.

    Equal events of a span are counted together first (``copies``), so repeats do not lengthen an array.
    """
    fields = ["time_unix_nano", "event_name", "event_attr_key", "value"]
    events = (
        points.where(has_identity() & F.col("event_name").isNotNull())
        .groupBy(*SPAN_KEY, *fields)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    counts = span_rows.where("event_count > 0").select(*SPAN_KEY, F.col("event_count").alias("_n"))
    return in_parts(events, SPAN_KEY, counts, F.struct(*fields, "copies"), "events", part_size)
