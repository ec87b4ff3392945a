"""Queries on span points."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.labels import series_key
from pulselake.functions.text import has_identity
from pulselake.gallery.registry import query
from pulselake.gallery.tables import order_span_points, span_requests
from pulselake.operators.traces import (
    nested_events, nested_spans, newest_traces, span_events, spans, spans_of, traces,
)
from pulselake.plans.queries import TRACE_LIMIT, matching_span_points, trace_query
from pulselake.sources.tables import scan, where_labels
from pulselake.streaming.ingest import flatten

# The first point of a span or trace: by time, then name, service, parent, value.
POINTS = """
p AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id,
         CASE WHEN l_linenumber = 1 THEN '' ELSE '1' END AS parent_span_id, 'supplier-' || l_suppkey AS service,
         l_returnflag || '/' || l_linestatus AS span_name, epoch_us(l_shipdate) * 1000 AS t0, l_quantity AS value,
         CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS code, l_partkey AS part
  FROM lineitem
)"""
SPANS = """
s AS (
  SELECT *, max(t0) OVER k AS end_at, max(code) OVER k AS status_code, count(*) OVER k AS point_count,
         row_number() OVER (PARTITION BY trace_id, span_id ORDER BY t0, span_name, service, value) AS r
  FROM p WINDOW k AS (PARTITION BY trace_id, span_id)
)"""
TRACES = """
t AS (
  SELECT trace_id, arg_min(span_name, (t0, span_id)) AS name, arg_min(service, (t0, span_id)) AS service,
         min(t0) AS start_unix_nano, max(end_at) AS end_unix_nano,
         CASE WHEN max(status_code) = 2 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS span_count
  FROM s WHERE r = 1 GROUP BY trace_id
)"""
TRACE_COLUMNS = """trace_id, name, service, CAST(start_unix_nano AS BIGINT) AS start_unix_nano,
       CAST(end_unix_nano AS BIGINT) AS end_unix_nano,
       (end_unix_nano - start_unix_nano) / 1000000.0::DOUBLE AS duration_ms, status, span_count"""


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id, l_quantity AS value
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01'""")
def spans_scan_range(spark, sf_dir):
    rows = scan(order_span_points(spark, sf_dir), "1997-01-01T00:00:00Z", "1997-03-01T00:00:00Z")
    return rows.select("trace_id", "span_id", "value")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, l_quantity AS value FROM lineitem
WHERE l_suppkey = 7 AND l_returnflag = 'R' AND l_linestatus = 'F'""")
def spans_by_label(spark, sf_dir):
    wanted = {"service.name": "supplier-7", "span.name": "R/F"}
    return where_labels(order_span_points(spark, sf_dir), "traces", wanted).select("trace_id", "value")


@query(f"""
WITH {POINTS}, {SPANS}
SELECT trace_id, span_id, parent_span_id, service, span_name, CAST(t0 AS BIGINT) AS start_unix_nano,
       CAST(end_at AS BIGINT) AS end_unix_nano, (end_at - t0) / 1000000.0::DOUBLE AS duration_ms, status_code, point_count
FROM s WHERE r = 1""")
def span_assembly(spark, sf_dir):
    return spans(order_span_points(spark, sf_dir)).select(
        "trace_id", "span_id", "parent_span_id", "service", "span_name", "start_unix_nano", "end_unix_nano",
        "duration_ms", "status_code", "point_count",
    )


@query(f"WITH {POINTS}, {SPANS}, {TRACES} SELECT {TRACE_COLUMNS} FROM t")
def trace_assembly(spark, sf_dir):
    return traces(spans(order_span_points(spark, sf_dir)))


@query(f"""
WITH {POINTS}, {SPANS}
SELECT trace_id, span_id, '{{"part":"' || part || '","service.name":"' || service || '"}}' AS labels
FROM s WHERE r = 1 AND point_count = 1""")
def span_label_strip(spark, sf_dir):
    """Labels of a span without its identity."""
    rows = spans(order_span_points(spark, sf_dir)).where("point_count = 1")
    return rows.select("trace_id", "span_id", series_key(F.col("labels")).alias("labels"))


@query(f"""
WITH {POINTS}, {SPANS}, {TRACES}
SELECT {TRACE_COLUMNS} FROM t ORDER BY start_unix_nano DESC, trace_id LIMIT 20""")
def recent_traces(spark, sf_dir):
    return newest_traces(traces(spans(order_span_points(spark, sf_dir))), 20)


@query(f"""
WITH {POINTS}, {SPANS}, {TRACES}, n AS (SELECT trace_id FROM t ORDER BY start_unix_nano DESC, trace_id LIMIT 100)
SELECT trace_id, 0 AS part,
       string_agg(span_id || '@' || t0 || '-' || end_at || ':' || status_code, ' ' ORDER BY t0, span_id) AS spans
FROM s JOIN n USING (trace_id) WHERE r = 1 GROUP BY trace_id""")
def trace_spans_nested(spark, sf_dir):
    """The newest traces with their spans attached."""
    points = order_span_points(spark, sf_dir)
    newest = newest_traces(traces(spans(points)), 100)
    rows = nested_spans(spans_of(points, newest), newest)
    text = F.transform(
        "spans",
        lambda s: F.concat(
            s["span_id"], F.lit("@"), s["start_unix_nano"].cast("string"), F.lit("-"),
            s["end_unix_nano"].cast("string"), F.lit(":"), s["status_code"].cast("string"),
        ),
    )
    return rows.select("trace_id", "part", F.array_join(text, " ").alias("spans"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id, l_quantity AS value FROM lineitem
WHERE contains(CAST(l_orderkey AS VARCHAR), '12') OR contains('supplier-' || l_suppkey, '12')""")
def trace_search(spark, sf_dir):
    """A text in trace id, service or span name, point by point."""
    return matching_span_points(order_span_points(spark, sf_dir), "12").select("trace_id", "span_id", "value")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, count(*) AS points FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem
                     WHERE contains(CAST(l_orderkey AS VARCHAR), '99') OR contains('supplier-' || l_suppkey, '99'))
GROUP BY 1""")
def trace_search_whole(spark, sf_dir):
    """All points of the traces with a match."""
    rows = matching_span_points(order_span_points(spark, sf_dir), "99", whole_trace=True)
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("points"))


@query(f"""
WITH {POINTS.replace('FROM lineitem', "FROM lineitem WHERE contains(CAST(l_orderkey AS VARCHAR), 'R/F') OR contains('supplier-' || l_suppkey, 'R/F') OR contains(l_returnflag || '/' || l_linestatus, 'R/F')")},
{SPANS}, {TRACES}
SELECT {TRACE_COLUMNS} FROM t ORDER BY start_unix_nano DESC, trace_id LIMIT 100""")
def trace_text_query(spark, sf_dir):
    """A trace query: text, range, usual limit."""
    return trace_query(order_span_points(spark, sf_dir), "R/F", "1990-01-01T00:00:00Z", "2010-01-01T00:00:00Z", TRACE_LIMIT)


@query("""
SELECT count(*) AS points FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'O'""")
def identity_guard(spark, sf_dir):
    """Points without a trace or span id are left out."""
    points = order_span_points(spark, sf_dir)
    partial = points.withColumn(
        "trace_id", F.when(~F.col("span_name").startswith("A"), F.col("trace_id"))
    ).withColumn("span_id", F.when(~F.col("span_name").endswith("O"), F.col("span_id")))
    return partial.where(has_identity()).agg(F.count(F.lit(1)).alias("points"))


EVENTS = """
e AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id,
         epoch_us(l_shipdate) * 1000 AS t0, unnest(['tax', 'part', 'cheap']) AS key,
         unnest([l_tax, l_partkey::DOUBLE, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END]) AS value
  FROM lineitem
)"""


@query(f"""
WITH {EVENTS}
SELECT trace_id, span_id, CAST(t0 AS BIGINT) AS time_unix_nano, 'pack' AS event_name, key, value FROM e WHERE value <> 0""")
def span_event_rows(spark, sf_dir):
    """Numeric attributes of span events, with their values."""
    rows = span_events(flatten(span_requests(spark, sf_dir), "traces"))
    return rows.select(
        "trace_id", "span_id", "time_unix_nano", "event_name", F.explode("attributes").alias("key", "value")
    )


@query(f"""
WITH {EVENTS}, c AS (
  SELECT trace_id, span_id, t0, key, value, count(*) AS copies FROM e WHERE value <> 0 GROUP BY ALL
)
SELECT trace_id, span_id, string_agg(key || 'x' || copies, ' ' ORDER BY t0, key, value) AS events
FROM c GROUP BY 1, 2""")
def span_events_nested(spark, sf_dir):
    """The events of each span as an ordered array."""
    points = flatten(span_requests(spark, sf_dir), "traces")
    rows = nested_events(points, spans(points))
    text = F.transform("events", lambda e: F.concat(e["event_attr_key"], F.lit("x"), e["copies"].cast("string")))
    return rows.select("trace_id", "span_id", F.array_join(text, " ").alias("events"))
