"""Queries on log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.labels import decode_labels, merge_labels, series_key
from pulselake.functions.values import number_text, severity_level, span_kind_text
from pulselake.gallery.registry import query
from pulselake.gallery.tables import document_logs, event_logs, labels, read
from pulselake.operators.logs import at_level, error_rates, level_counts, result_rows, search, unpack_message
from pulselake.plans.queries import LOG_LIMIT, log_query, result_json
from pulselake.sources.tables import scan

START, END = "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z"
ALL = {"start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z"}
WEEK = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"


@query(f"SELECT event_id, props AS message FROM events WHERE event_type = 'error' AND {WEEK}")
def logs_scan_range(spark, sf_dir):
    return at_level(scan(event_logs(spark, sf_dir), START, END), "ERROR").select("event_id", "message")


@query("SELECT event_id FROM events WHERE upper(event_type) = 'PURCHASE'")
def log_level(spark, sf_dir):
    return at_level(event_logs(spark, sf_dir), "PURCHASE").select("event_id")


@query("SELECT upper(event_type) AS level, count(*) AS n FROM events GROUP BY 1")
def log_level_counts(spark, sf_dir):
    return level_counts(event_logs(spark, sf_dir))


@query("""
SELECT doc_id FROM documents
WHERE contains(lower(text), 'tion on') OR contains(lower(lang), 'tion on') OR contains(lower(source), 'tion on')""")
def log_search(spark, sf_dir):
    """Case does not count; the whole message is searched."""
    return search(document_logs(spark, sf_dir), "Tion ON").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(source), 'src1')")
def log_search_labels(spark, sf_dir):
    """Label values are searched too."""
    return search(document_logs(spark, sf_dir), "SRC1").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'The')")
def log_substring(spark, sf_dir):
    """A plain substring, case counts."""
    logs = document_logs(spark, sf_dir)
    return logs.where(F.contains("message", F.lit("The"))).select("doc_id", F.col("labels")["lang"].alias("lang"))


@query("""
SELECT CAST((1704067200 + doc_id) * 1000000000 AS BIGINT) AS time_unix_nano, 'INFO' AS level, text AS message
FROM documents WHERE contains(lower(text), 'en') OR contains(lower(lang), 'en') OR contains(lower(source), 'en')
ORDER BY doc_id LIMIT 100""")
def log_text_query(spark, sf_dir):
    """A log query: text, range, default limit."""
    return log_query(document_logs(spark, sf_dir), "EN", limit=LOG_LIMIT, **ALL).select("time_unix_nano", "level", "message")


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, props AS message,
       '{"service.name":"user-' || user_id || '"}' AS labels
FROM events WHERE event_type = 'error' ORDER BY ts LIMIT 25""")
def log_query_limited(spark, sf_dir):
    rows = log_query(event_logs(spark, sf_dir), limit=25, level="ERROR", **ALL)
    return rows.select("time_unix_nano", "message", F.to_json("labels").alias("labels"))


@query("SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, upper(event_type) AS level, props AS message FROM events")
def log_result_rows(spark, sf_dir):
    return result_rows(event_logs(spark, sf_dir)).select("time_unix_nano", "level", "message")


@query("""
SELECT '{"time_unix_nano":' || (epoch_us(ts) * 1000) || ',"level":"' || upper(event_type) || '"}' AS json FROM events""")
def result_as_json(spark, sf_dir):
    return result_json(event_logs(spark, sf_dir).select("time_unix_nano", "level"))


@query("""
SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n,
       round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate
FROM events GROUP BY 1""")
def error_rate(spark, sf_dir):
    day = F.col("ts").cast("date").cast("string").alias("day")
    return error_rates(event_logs(spark, sf_dir), day).withColumn("error_rate", F.round("error_rate", 6))


@query("""
SELECT CAST(l_linenumber * 4 - 3 AS INTEGER) AS number,
       CASE l_linenumber * 4 - 3 WHEN 1 THEN 'TRACE' WHEN 5 THEN 'DEBUG' WHEN 9 THEN 'INFO' WHEN 13 THEN 'WARN'
            WHEN 17 THEN 'ERROR' WHEN 21 THEN 'FATAL' ELSE 'INFO' END AS level, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def severity_map(spark, sf_dir):
    number = (F.col("l_linenumber") * 4 - 3).cast("int")
    rows = read(spark, sf_dir, "lineitem").select(number.alias("number"), severity_level(number).alias("level"))
    return rows.groupBy("number", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_linenumber AS number,
       coalesce(list_extract(['INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER'], l_linenumber), 'UNSPECIFIED') AS kind,
       count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def span_kind_map(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("number"), span_kind_text(F.col("l_linenumber")).alias("kind")
    )
    return rows.groupBy("number", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text
FROM events""")
def number_as_text(spark, sf_dir):
    """Shortest text of a number, without a trailing '.0'."""
    return read(spark, sf_dir, "events").select("event_id", number_text(F.col("value")).alias("text"))


@query("""
SELECT doc_id, '{"lang":"' || lang || '","service.name":"' || source || '"}' AS labels, text AS message FROM documents""")
def message_unpack(spark, sf_dir):
    """A message packed into the labels is taken out again."""
    logs = document_logs(spark, sf_dir)
    packed = logs.select("doc_id", merge_labels(F.col("labels"), labels(message=F.col("message"))).alias("labels"))
    rows = unpack_message(packed)
    return rows.select("doc_id", series_key(F.col("labels")).alias("labels"), "message")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def labels_decode(spark, sf_dir):
    """Labels held as JSON text."""
    return event_logs(spark, sf_dir).select("event_id", decode_labels(F.col("message"))["k"].alias("k"))


@query("""
SELECT event_id, '{"a":"left","event":"' || event_type || '","user":"' || user_id || '"}' AS labels FROM events""")
def labels_override(spark, sf_dir):
    """Of two label maps the right one wins."""
    left = labels(a=F.lit("left"), event=F.lit("left"))
    right = labels(event=F.col("event_type"), user=F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", series_key(merge_labels(left, right)).alias("labels"))
