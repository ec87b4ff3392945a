"""OTLP/JSON requests made from the given tables, flattened back to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.gallery.registry import query
from pulselake.gallery.tables import (
    gauge_requests, histogram_requests, log_requests, read, span_requests, sum_requests, summary_requests,
)
from pulselake.sources.otlp import parse
from pulselake.streaming.ingest import flatten

K = "json_extract_string(props, '$.k')"


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, 'user-' || user_id AS service, value,
       'gauge' AS point_kind,
       '{"__name__":"' || event_type || '","host":"host-' || event_type || '","k":"","service.name":"user-' || user_id || '"}'
         AS series_key, CAST(ts AS DATE)::VARCHAR AS dt
FROM events""")
def otlp_gauge(spark, sf_dir):
    rows = flatten(gauge_requests(spark, sf_dir), "metrics")
    return rows.select(
        "time_unix_nano", "name", "service", "value", "point_kind", "series_key", F.col("dt").cast("string").alias("dt")
    )


@query(f"""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, {K} AS k
FROM events""")
def otlp_attribute_kinds(spark, sf_dir):
    """Attributes that are no text, written as text on request."""
    rows = flatten(gauge_requests(spark, sf_dir), "metrics", stringify=True)
    return rows.select("time_unix_nano", "name", F.col("labels")["k"].alias("k"))


@query(f"""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, floor(value) AS value, 'sum' AS point_kind,
       '{{"__name__":"' || event_type || '","k":"' || {K} || '","service.name":"user-' || user_id || '"}}' AS series_key
FROM events""")
def otlp_sum(spark, sf_dir):
    rows = flatten(sum_requests(spark, sf_dir), "metrics")
    return rows.select("time_unix_nano", "value", "point_kind", "series_key")


HISTOGRAM = """
SELECT 'order-' || o_orderkey AS service, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS time_unix_nano,
       unnest(['count', 'sum', 'bucket', 'bucket', 'bucket'{inf}]) AS kind,
       unnest([NULL, NULL, '0.005', '10', '2.5e+06'{inf_le}]) AS le,
       unnest([o_custkey * 3 + 6, o_totalprice, o_custkey, o_custkey + 1, o_custkey + 2{inf_n}]::DOUBLE[]) AS value,
       o_orderstatus AS status
FROM orders"""


def _histogram(spark, sf_dir, **options):
    rows = flatten(histogram_requests(spark, sf_dir), "metrics", **options)
    labels = F.col("labels")
    return rows.select(
        "service", "time_unix_nano", labels["__metric_type__"].alias("kind"), labels["le"].alias("le"), "value",
        labels["status"].alias("status"),
    )


@query(HISTOGRAM.format(inf="", inf_le="", inf_n=""))
def otlp_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(HISTOGRAM.format(inf=", 'bucket'", inf_le=", '+Inf'", inf_n=", 3"))
def otlp_histogram_inf(spark, sf_dir):
    """With the unbounded last bucket."""
    return _histogram(spark, sf_dir, include_inf=True)


@query("""
SELECT 'order-' || o_orderkey AS service, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS time_unix_nano,
       unnest(['count', 'sum', 'quantile', 'quantile']) AS point_kind, unnest([NULL, NULL, '0.5', '0.99']) AS quantile,
       unnest([o_custkey::DOUBLE, o_totalprice, o_totalprice / 2, o_totalprice]) AS value
FROM orders""")
def otlp_summary(spark, sf_dir):
    rows = flatten(summary_requests(spark, sf_dir), "metrics")
    return rows.select("service", "time_unix_nano", "point_kind", F.col("labels")["quantile"].alias("quantile"), "value")


@query("""
SELECT CAST((1704067200 + doc_id) * 1000000000 AS BIGINT) AS time_unix_nano,
       CASE doc_id % 25 WHEN 1 THEN 'TRACE' WHEN 5 THEN 'DEBUG' WHEN 13 THEN 'WARN' WHEN 17 THEN 'ERROR'
            WHEN 21 THEN 'FATAL' ELSE 'INFO' END AS level,
       CAST(doc_id % 25 AS INTEGER) AS severity_number, text AS message, source AS service,
       '{"chars":"","lang":"' || lang || '","service.name":"' || source || '"}' AS labels
FROM documents""")
def otlp_logs(spark, sf_dir):
    rows = flatten(log_requests(spark, sf_dir), "logs")
    return rows.select(
        "time_unix_nano", "level", "severity_number", "message", "service",
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("labels"),
    )


@query("SELECT 't' || doc_id AS trace_id, n_chars::VARCHAR AS chars FROM documents")
def otlp_logs_with_ids(spark, sf_dir):
    """Trace ids kept as a label, numbers as text."""
    labels = F.col("labels")
    rows = flatten(log_requests(spark, sf_dir), "logs", keep_ids=True, stringify=True)
    return rows.select(labels["trace.id"].alias("trace_id"), labels["chars"].alias("chars"))


@query("""
WITH s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id,
         CASE WHEN l_linenumber > 1 THEN '1' ELSE '' END AS parent_span_id, 'supplier-' || l_suppkey AS service,
         'ship ' || l_returnflag AS span_name,
         coalesce(list_extract(['INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER'], l_linenumber), 'UNSPECIFIED') AS span_kind,
         epoch_us(l_shipdate) * 1000 AS t0, epoch_us(l_shipdate) * 1000 + l_quantity::BIGINT * 1000500 AS end_at,
         CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS code, l_tax, l_partkey, l_discount, l_linestatus
  FROM lineitem
)
SELECT trace_id, span_id, parent_span_id, service, span_name, span_kind, l_linestatus AS status, point_type, value,
       CAST(point_at AS BIGINT) AS time_unix_nano, status_code, status_message, event_attr_key
FROM (
  SELECT *, 'duration' AS point_type, ((end_at - t0) // 1000)::DOUBLE AS value, t0 AS point_at, NULL AS status_code,
         NULL AS status_message, NULL AS event_attr_key FROM s
  UNION ALL SELECT *, 'status', code, end_at, code, CASE code WHEN 2 THEN 'returned' ELSE '' END, NULL FROM s
  UNION ALL SELECT *, 'event', l_tax, t0, NULL, NULL, 'tax' FROM s WHERE l_tax <> 0
  UNION ALL SELECT *, 'event', l_partkey, t0, NULL, NULL, 'part' FROM s WHERE l_partkey <> 0
  UNION ALL SELECT *, 'event', 1, t0, NULL, NULL, 'cheap' FROM s WHERE l_discount > 0.05
)""")
def otlp_spans(spark, sf_dir):
    rows = flatten(span_requests(spark, sf_dir), "traces")
    return rows.select(
        "trace_id", "span_id", "parent_span_id", "service", "span_name", "span_kind",
        F.col("labels")["status"].alias("status"), "point_type", "value", "time_unix_nano", "status_code",
        "status_message", "event_attr_key",
    )


@query("""
WITH b AS (
  SELECT doc_id, '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"' || text || '"}}]}]}]}' AS body
  FROM documents
)
SELECT doc_id, CASE WHEN json_valid(body) THEN 0 ELSE 1 END AS malformed FROM b""")
def malformed_split(spark, sf_dir):
    """Documents pasted into a request without escaping; many are no JSON then."""
    body = F.concat(
        F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"'), F.col("text"), F.lit('"}}]}]}]}')
    )
    bodies = read(spark, sf_dir, "documents").select("doc_id", body.alias("value"))
    return parse(bodies, "logs").select("doc_id", F.col("malformed").cast("int").alias("malformed"))


BODY = """'{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"intValue":' || n_chars || '}}]}]}]}'"""


@query(f"""
WITH b AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {BODY} WHEN 1 THEN {BODY} || '],"x":[{{}}'
    WHEN 2 THEN {BODY} || '],"bodies":[' || {BODY} ELSE {BODY} || ',' || {BODY} END AS body FROM documents
)
SELECT doc_id, CASE WHEN json_valid(body) THEN 0 ELSE 1 END AS malformed FROM b""")
def malformed_joined(spark, sf_dir):
    """Bodies that are valid only as parts of a longer text."""
    docs, kind = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    one = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"intValue":'), F.col("n_chars"), F.lit("}}]}]}]}"))
    body = F.when(kind == 0, one).when(kind == 1, F.concat(one, F.lit('],"x":[{}')))
    body = body.when(kind == 2, F.concat(one, F.lit('],"bodies":['), one)).otherwise(F.concat(one, F.lit(","), one))
    return parse(docs.select("doc_id", body.alias("value")), "logs").select("doc_id", F.col("malformed").cast("int").alias("malformed"))
