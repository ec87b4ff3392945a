import pytest
from helpers import BASE_NANOS, SECOND, exchanges, iso, plan
from pyspark.sql import functions as F

from pulselake.operators.traces import nested_events, nested_spans, newest_traces, span_events, spans, traces
from pulselake.plans.queries import matching_span_points, trace_details, trace_query
from pulselake.streaming.ingest import flatten

SCHEMA = (
    "time_unix_nano bigint, trace_id string, span_id string, parent_span_id string, service string, span_name string, "
    "span_kind string, point_type string, value double, event_name string, event_attr_key string, status_code int, "
    "labels map<string,string>"
)


def span_points(spark, rows):
    """Rows of (offset ms, trace, span, type, more)."""
    data = []
    for ms, trace, span, kind, more in rows:
        labels = {"trace.id": trace, "span.id": span, "service.name": more.get("service", "svc"), "host": "h",
                  "span.kind": "SERVER"}
        data.append((
            BASE_NANOS + int(ms * 1_000_000), trace, span, more.get("parent", ""), more.get("service", "svc"),
            more.get("name", "op"), "SERVER", kind, more.get("value", 0.0), more.get("event"), more.get("key"),
            more.get("code"), {k: v for k, v in labels.items() if v is not None},
        ))
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("ts", F.timestamp_micros((F.col("time_unix_nano") / 1000).cast("bigint")))


@pytest.fixture(scope="module")
def sample(spark):
    return span_points(spark, [
        (10, "t1", "a", "duration", {"name": "GET /"}),
        (25.5, "t1", "a", "status", {"name": "GET /", "code": 1}),
        (12, "t1", "b", "duration", {"name": "child", "parent": "a"}),
        (13, "t1", "b", "event", {"name": "child", "parent": "a", "event": "e", "key": "n", "value": 20.0}),
        (13, "t1", "b", "event", {"name": "child", "parent": "a", "event": "e", "key": "n", "value": 20.0}),
        (20, "t1", "b", "status", {"name": "child", "parent": "a", "code": 2}),
        (5, "t2", "a", "duration", {"name": "GET /x", "service": ""}),
        (6, "t2", "a", "status", {"name": "GET /x", "service": "", "code": 0}),
        (1, None, "x", "duration", {}),
        (1, "t3", None, "duration", {}),
    ])


def test_spans_are_keyed_by_trace_and_span(sample):
    rows = {(r.trace_id, r.span_id): r for r in spans(sample).collect()}
    assert set(rows) == {("t1", "a"), ("t1", "b"), ("t2", "a")}
    a, b = rows["t1", "a"], rows["t1", "b"]
    assert (a.span_name, a.duration_ms, a.status_code, a.event_count) == ("GET /", 15.5, 1, 0)
    assert (b.parent_span_id, b.duration_ms, b.status_code, b.event_count) == ("a", 8.0, 2, 2)
    assert a.labels == {"service.name": "svc", "host": "h"}


def test_traces(sample):
    rows = {r.trace_id: r for r in traces(spans(sample)).collect()}
    assert set(rows) == {"t1", "t2"}
    t1, t2 = rows["t1"], rows["t2"]
    assert (t1.name, t1.service, t1.duration_ms, t1.status, t1.span_count) == ("GET /", "svc", 15.5, "ERROR", 2)
    assert (t2.name, t2.service, t2.duration_ms, t2.status) == ("GET /x", "unknown", 1.0, "OK")


def test_newest_first_and_limit_zero(sample):
    rows = traces(spans(sample))
    assert [r.trace_id for r in newest_traces(rows, 1).collect()] == ["t1"]
    assert [r.trace_id for r in newest_traces(rows, 0).collect()] == ["t1", "t2"]


def test_nested_spans_and_events(sample):
    span_rows = spans(sample)
    rows = {r.trace_id: r.spans for r in nested_spans(span_rows, traces(span_rows)).collect()}
    assert [s.span_id for s in rows["t1"]] == ["a", "b"] and [s.span_id for s in rows["t2"]] == ["a"]
    (events,) = nested_events(sample, span_rows).collect()
    assert [(e.event_name, e.value, e.copies) for e in events.events] == [("e", 20.0, 2)]
    assert [r.attributes for r in span_events(sample).collect()] == [{"n": 20.0}, {"n": 20.0}]


def test_a_huge_trace_is_nested_in_parts(spark):
    df = span_points(spark, [(i, "hot", f"s{i}", "duration", {}) for i in range(1000)] + [(0, "cold", "s", "duration", {})])
    span_rows = spans(df)
    rows = nested_spans(span_rows, traces(span_rows), part_size=50).collect()
    hot = [r for r in rows if r.trace_id == "hot"]
    assert len(hot) == 20 and max(len(r.spans) for r in hot) < 100
    assert sorted(s.span_id for r in hot for s in r.spans) == sorted(f"s{i}" for i in range(1000))
    assert len([r for r in rows if r.trace_id == "cold"]) == 1


def test_search(sample):
    assert matching_span_points(sample, "child").count() == 4
    assert matching_span_points(sample, "CHILD").count() == 0
    assert matching_span_points(sample, "child", whole_trace=True).count() == 6
    assert matching_span_points(sample, "t2").count() == 2
    assert matching_span_points(sample, "").count() == 10
    (row,) = trace_query(sample, "child", iso(-1), iso(1)).collect()
    assert (row.trace_id, row.name, row.span_count) == ("t1", "child", 1)
    assert trace_query(sample, "", iso(-1), iso(1), limit=1).count() == 1


def test_trace_details(sample):
    (row,) = trace_details(sample, "GET", iso(-1), iso(1), limit=1).collect()
    assert (row.trace_id, row.part, [s.span_id for s in row.spans]) == ("t1", 0, ["a"])
    (row,) = trace_details(sample, "GET", iso(-1), iso(1), limit=1, whole_trace=True).collect()
    assert (row.span_count, [s.span_id for s in row.spans], row.status) == (2, ["a", "b"], "ERROR")


def test_raw_points_are_shuffled_once_and_by_span(sample):
    text = plan(traces(spans(sample)))
    assert exchanges(traces(spans(sample))) == 2
    assert "partial_min" in text and "labels" not in text.split("Exchange hashpartitioning(trace_id")[1]


def test_events_meet_their_counts_without_broadcast(sample):
    assert "Broadcast" not in plan(nested_events(sample, spans(sample)))
    assert "SortMergeJoin" in plan(nested_events(sample, spans(sample)))


def test_points_of_a_span_are_made_once(spark):
    """Spark tests a list before it is exploded by making it once more; a span always has points."""
    body = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s","events":[{"name":"e","attributes":[{"key":"n","value":{"intValue":"3"}}]}]},{}]}]}]}'
    bodies = spark.createDataFrame([(body,)], "value string")
    rows = flatten(bodies, "traces")
    text = plan(rows.select("span_id", "point_type", "event_name", F.col("labels")["event.name"].alias("l"))).split("== Initial Plan ==")[-1]
    assert text.count("point_type, event") == 1
    found = sorted((r.span_id, r.point_type, r.labels.get("event.name"), r.labels.get("span.id")) for r in rows.collect())
    assert found == [("", "duration", None, ""), ("", "status", None, ""), ("s", "duration", None, "s"), ("s", "event", "e", "s"), ("s", "status", None, "s")]
