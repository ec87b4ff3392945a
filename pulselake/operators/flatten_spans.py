"""OTLP traces requests to span points: duration, numeric event attributes, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.labels import attribute_entries, entry, label_map, merge_labels, no_entries
from pulselake.functions.times import div, ts_of_nanos
from pulselake.functions.values import int64, span_kind_text
from pulselake.schemas import SPAN_POINTS

POINT_LABELS = ("event.name", "event.attr.key", "status.code", "status.message")


def _point(
    kind: str,
    at: Column,
    value: Column,
    event_name: Column | None = None,
    event_attr_key: Column | None = None,
    status_code: Column | None = None,
    status_message: Column | None = None,
) -> Column:
    def or_null(c: Column | None, dtype: str) -> Column:
        return (F.lit(None) if c is None else c).cast(dtype)

    return F.struct(
        F.lit(kind).alias("point_type"),
        at.alias("time_unix_nano"),
        value.cast("double").alias("value"),
        or_null(event_name, "string").alias("event_name"),
        or_null(event_attr_key, "string").alias("event_attr_key"),
        or_null(status_code, "int").alias("status_code"),
        or_null(status_message, "string").alias("status_message"),
    )


def _numeric(value: Column) -> Column:
    """First of: a double that is not 0, an integer that is not 0, true as 1; NULL for anything else."""
    double = value["doubleValue"]
    integer = value["intValue"].try_cast("double")
    return F.when(double != 0, double).when(integer != 0, integer).when(value["boolValue"], F.lit(1.0))


def _event_points(span: Column, start: Column) -> Column:
    def of_event(event: Column) -> Column:
        given = int64(event["timeUnixNano"])
        at = F.when(given == 0, start).otherwise(given)
        name = F.coalesce(event["name"], F.lit(""))
        numbers = F.transform(
            event["attributes"],
            lambda a: F.struct(F.coalesce(a["key"], F.lit("")).alias("key"), _numeric(a["value"]).alias("value")),
        )
        return F.transform(
            F.filter(numbers, lambda a: a["value"].isNotNull()),
            lambda a: _point(
                "event",
                at,
                a["value"],
                event_name=name,
                event_attr_key=a["key"],
            ),
        )

    # Events without attributes give NULL lists, which flatten would turn into one NULL.
    lists = F.filter(F.transform(span["events"], of_event), lambda points: points.isNotNull())
    return F.coalesce(F.flatten(lists), F.array())


def _has_point_labels(base: Column) -> Column:
    """Whether a span's own labels have a name that a label of a point may have."""
    return F.arrays_overlap(F.map_keys(base), F.array(*map(F.lit, POINT_LABELS)))


def _point_labels(base: Column, clash: Column, point: Column) -> Column:
    """The labels of a span and of its point; the point's win."""
    name, key, code, message = (F.lit(label) for label in POINT_LABELS)
    of_code = [code, point["status_code"].cast("string")]

    def merged(*pairs: Column) -> Column:
        own = F.create_map(*pairs)
        return F.when(~clash, F.map_concat(base, own)).otherwise(merge_labels(base, own))

    return (
        F.when(point["point_type"] == "duration", base)
        .when(point["point_type"] == "event", merged(name, point["event_name"], key, point["event_attr_key"]))
        .when(point["status_message"] == "", merged(*of_code))
        .otherwise(merged(*of_code, message, point["status_message"]))
    )


def flatten_spans(requests: DataFrame, stringify: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Span points of parsed requests (column ``request``).

    Each span gives a duration point at its start (whole microseconds), one point per numeric event
    attribute, and a status point at its end.
    """
    spans = (
        requests.select(*keep, F.explode("request.resourceSpans").alias("r"))
        .select(*keep, F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s"))
        .select(*keep, "resource", F.explode("s.spans").alias("span"))
        .select(
            *keep,
            "span",
            int64(F.col("span.startTimeUnixNano")).alias("start"),
            int64(F.col("span.endTimeUnixNano")).alias("end"),
            attribute_entries(F.col("resource"), stringify).alias("resource"),
        )
    )
    span = F.col("span")
    code = F.coalesce(span["status"]["code"], F.lit(0))
    message = F.coalesce(span["status"]["message"], F.lit(""))
    status = _point("status", F.col("end"), code, status_code=code, status_message=message)
    duration = _point("duration", F.col("start"), div(F.col("end") - F.col("start"), 1000))
    points = F.concat(F.array(duration), _event_points(span, F.col("start")), F.array(status))

    text = lambda field: F.coalesce(span[field], F.lit(""))
    services = F.filter("resource", lambda e: e["key"] == "service.name")
    ids = ["trace_id", "span_id", "parent_span_id", "service", "span_name", "span_kind"]
    identified = spans.select(
        *keep,
        text("traceId").alias("trace_id"),
        text("spanId").alias("span_id"),
        text("parentSpanId").alias("parent_span_id"),
        text("name").alias("span_name"),
        span_kind_text(span["kind"]).alias("span_kind"),
        F.coalesce(F.try_element_at(services, F.lit(-1))["value"], F.lit("")).alias("service"),
        F.concat("resource", attribute_entries(span["attributes"], stringify)).alias("attributes"),
        points.alias("points"),
    )
    base = F.concat(
        F.col("attributes"),
        F.array(
            entry("service.name", F.col("service")),
            entry("span.name", F.col("span_name")),
            entry("span.kind", F.col("span_kind")),
            entry("trace.id", F.col("trace_id")),
            entry("span.id", F.col("span_id")),
        ),
        F.when(F.col("parent_span_id") != "", F.array(entry("parent.span.id", F.col("parent_span_id")))).otherwise(
            no_entries()
        ),
    )
    # The labels of a span are made once, before its points are listed. A span always has points; explode would make
    # the list a second time to test that.
    rows = (
        identified.select(*keep, *ids, base.alias("entries"), "points")
        .select(*keep, *ids, label_map(F.col("entries")).alias("base"), "points")
        .select(*keep, *ids, "base", _has_point_labels(F.col("base")).alias("clash"), F.explode_outer("points").alias("p"))
    )
    ts = ts_of_nanos(F.col("p.time_unix_nano"))
    return rows.select(
        *keep,
        F.col("p.time_unix_nano"),
        ts.alias("ts"),
        *ids,
        F.col("p.point_type"),
        F.col("p.value"),
        F.col("p.event_name"),
        F.col("p.event_attr_key"),
        F.col("p.status_code"),
        F.col("p.status_message"),
        _point_labels(F.col("base"), F.col("clash"), F.col("p")).alias("labels"),
        ts.cast("date").alias("dt"),
    ).select(*keep, *[f.name for f in SPAN_POINTS.fields])
