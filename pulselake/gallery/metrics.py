"""Queries on metric points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pulselake.functions.aggregates import latest, named_aggregates
from pulselake.functions.labels import label_contains, label_match_text, label_rlike
from pulselake.functions.times import between_ts, div, query_range
from pulselake.gallery.registry import query
from pulselake.gallery.tables import event_points, read
from pulselake.operators.dedup import keep_last
from pulselake.operators.distribution import histogram, percentile
from pulselake.operators.panels import first_of_selectors, graph_series
from pulselake.operators.rate import rate
from pulselake.operators.series import (
    above_threshold, downsample, first_per_series, label_stats, latest_values, matrix, series, series_stats, summary,
    with_series_key,
)
from pulselake.plans.queries import METRIC_LIMIT, metric_points, metric_query
from pulselake.sources.tables import PROMOTED, scan, where_labels

START, END = "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z"
NOW = "2024-01-20T12:00:00Z"
WEEK = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"
NANOS = "epoch_us(ts) * 1000"
KEY = """'{"__name__":"' || event_type || '","service.name":"user-' || user_id || '"}'"""
K = "json_extract_string(props, '$.k')"


@query("""
SELECT event_type AS name, count(value) AS n, round(sum(value), 2) AS sum_value,
       min(epoch_us(ts)) AS min_us, max(epoch_us(ts)) AS max_us
FROM events GROUP BY event_type""")
def agg_by_label(spark, sf_dir):
    return label_stats(event_points(spark, sf_dir), "name").select(
        "name", "n", F.round("sum_value", 2).alias("sum_value"),
        F.unix_micros(F.col("min_ts").cast("timestamp")).alias("min_us"),
        F.unix_micros(F.col("max_ts").cast("timestamp")).alias("max_us"),
    )


@query(f"SELECT event_id, {NANOS} AS time_unix_nano, event_type AS name, value FROM events WHERE {WEEK}")
def points_scan_range(spark, sf_dir):
    return scan(event_points(spark, sf_dir), START, END).select("event_id", "time_unix_nano", "name", "value")


@query(f"SELECT event_id, {NANOS} AS time_unix_nano FROM events WHERE ts <= TIMESTAMP '2024-01-12'")
def store_default_range(spark, sf_dir):
    """An empty start means the epoch."""
    return scan(event_points(spark, sf_dir), None, END).select("event_id", "time_unix_nano")


@query("""
SELECT event_id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-20 11:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def query_default_range(spark, sf_dir):
    """An empty range means the last hour."""
    start, end = query_range(None, None, NOW)
    return scan(event_points(spark, sf_dir), start, end).select("event_id", "value")


@query("""
SELECT event_id, event_type AS name, value FROM events
WHERE ts > (SELECT TIMESTAMP '2024-01-10') AND ts < TIMESTAMP '2024-01-11'""")
def strict_range(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return points.where(between_ts("2024-01-10T00:00:00Z", "2024-01-11T00:00:00Z", strict=True)).select(
        "event_id", "name", "value"
    )


@query("SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def full_scan(spark, sf_dir):
    return event_points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT event_id, value FROM events WHERE event_type = 'error' AND {K} = '7'")
def label_selector(spark, sf_dir):
    points = event_points(spark, sf_dir, with_k=True)
    return where_labels(points, "metrics", {"__name__": "error", "k": "7"}).select("event_id", "value")


@query(f"SELECT event_id, value FROM events WHERE event_type = 'view' AND {K} = '12'")
def label_selector_text(spark, sf_dir):
    """Spaces and parts without '=' do not count."""
    points = event_points(spark, sf_dir, with_k=True)
    return where_labels(points, "metrics", " __name__ = view, k=12 , junk,").select("event_id", "value")


@query(f"""
SELECT event_id, event_type AS name FROM events
WHERE {K} = CASE event_type WHEN 'error' THEN '3' WHEN 'click' THEN '5' END""")
def label_selector_column(spark, sf_dir):
    """The selector comes with the row, as text."""
    wanted = F.when(F.col("name") == "error", "__name__=error, k=3").when(F.col("name") == "click", "k = 5,x").otherwise(
        "k=none"
    )
    points = event_points(spark, sf_dir, with_k=True)
    return points.where(label_match_text(wanted, F.col("labels"))).select("event_id", "name")


@query(f"SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id = 8 AND {WEEK}")
def pushed_labels(spark, sf_dir):
    """Name by its plain column, inside a time range."""
    points = scan(event_points(spark, sf_dir), START, END)
    return where_labels(points, "metrics", {"__name__": "purchase", "service.name": "user-8"}).select("event_id", "value")


@query("SELECT event_id, event_type AS name FROM events WHERE regexp_full_match(event_type, 'click|view')")
def label_regex(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return points.where(label_rlike("__name__", "click|view", promoted=PROMOTED["metrics"])).select("event_id", "name")


@query("SELECT event_id, event_type AS name FROM events WHERE contains('user-' || user_id, '-1')")
def label_substring(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return points.where(label_contains("service.name", "-1")).select("event_id", "name")


@query(f"""
WITH q AS (
  SELECT * FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id BETWEEN 1 AND 20)
), r AS (
  SELECT event_type, user_id, event_id, value,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS position
  FROM events JOIN q USING (event_type, user_id)
)
SELECT event_type AS name, 'user-' || user_id AS service, event_id, position, value FROM r WHERE position <= 100""")
def label_lookups(spark, sf_dir):
    """A hundred two-label lookups, the first hundred points each, in one scan."""
    names = ["click", "error", "purchase", "signup", "view"]
    wanted = [{"__name__": n, "service.name": f"user-{u}"} for n in names for u in range(1, 21)]
    found = first_of_selectors(event_points(spark, sf_dir), wanted, 100, ["event_id"])
    return found.select("name", "service", "event_id", "position", "value")


@query("SELECT event_id, value FROM events WHERE value > 100 AND event_type LIKE 'p%'")
def user_predicate(spark, sf_dir):
    """Any Column serves as a predicate."""
    predicate = (F.col("value") > 100) & F.col("labels")["__name__"].startswith("p")
    return metric_points(event_points(spark, sf_dir), start="2024-01-01T00:00:00Z", end="2024-02-01T00:00:00Z",
                         limit=0, where=predicate).select("event_id", "value")


def _whole(values: pd.Series) -> pd.Series:
    return (values * 100).round() % 100 == 0


@query("SELECT event_id, value FROM events WHERE CAST(round(value * 100) AS BIGINT) % 100 = 0")
def user_predicate_pandas(spark, sf_dir):
    """A vectorised Python predicate, where a Column cannot say it."""
    whole = F.pandas_udf(_whole, "boolean")
    return event_points(spark, sf_dir).where(whole("value")).select("event_id", "value")


@query(f"SELECT {KEY} AS series_key, count(*) AS points FROM events GROUP BY event_type, user_id")
def series_list(spark, sf_dir):
    return series(event_points(spark, sf_dir)).select("series_key", "points")


@query(f"""
SELECT {KEY} AS series_key, round(sum(value), 2) AS sum, round(avg(value), 9) AS avg, min(value) AS min,
       max(value) AS max, count(value) AS count
FROM events GROUP BY event_type, user_id""")
def named_aggregate_stats(spark, sf_dir):
    stats = series_stats(event_points(spark, sf_dir), ["sum", "avg", "min", "max", "count"])
    return stats.withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 9))


@query(f"""
SELECT {KEY} AS series_key,
       CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS chunk_start,
       string_agg(CAST(epoch_us(ts) // 1000000 AS VARCHAR) || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR),
                  ' ' ORDER BY ts, value) AS points
FROM events GROUP BY event_type, user_id, 2""")
def matrix_form(spark, sf_dir):
    rows = matrix(event_points(spark, sf_dir), 3600)
    text = F.transform(
        "values",
        lambda p: F.concat_ws(
            ":", p["unix_seconds"].cast("bigint").cast("string"), F.round(p["value"] * 100).cast("bigint").cast("string")
        ),
    )
    return rows.select("series_key", "chunk_start", F.array_join(text, " ").alias("points"))


@query("""
SELECT CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at, value FROM events
WHERE event_type = 'error' AND user_id = 8""")
def graph_points(spark, sf_dir):
    """The points of one series for a graph."""
    key = '{"__name__":"error","service.name":"user-8"}'
    return graph_series(matrix(event_points(spark, sf_dir)), key).select(F.unix_seconds("ts").alias("at"), "value")


@query(f"""
SELECT {KEY} AS series_key, arg_max(value, ts) AS latest FROM events GROUP BY event_type, user_id""")
def latest_value(spark, sf_dir):
    return latest_values(event_points(spark, sf_dir))


@query(f"""
SELECT {KEY} AS series_key, arg_max(value, ts) AS latest FROM events
GROUP BY event_type, user_id HAVING arg_max(value, ts) > 80""")
def threshold_series(spark, sf_dir):
    return above_threshold(event_points(spark, sf_dir), 80.0)


@query("""
SELECT event_type AS name, CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS bucket,
       round(avg(value), 9) AS avg, min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum,
       count(value) AS count, arg_max(value, ts) AS latest
FROM events GROUP BY 1, 2""")
def downsample_1h(spark, sf_dir):
    stats = named_aggregates(["avg", "min", "max", "sum", "count"]) + [latest().alias("latest")]
    rows = downsample(event_points(spark, sf_dir), 3600, stats, ("name",))
    return rows.select(
        "name", F.unix_seconds("bucket").alias("bucket"), F.round("avg", 9).alias("avg"), "min", "max",
        F.round("sum", 2).alias("sum"), "count", "latest",
    )


@query("""
SELECT event_type AS name, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type""")
def p95(spark, sf_dir):
    rows = percentile(event_points(spark, sf_dir), ["name"], 95, out="p95")
    return rows.select("name", "n", F.round("p95", 6).alias("p95"))


@query("""
SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY l_returnflag""")
def p95_large_groups(spark, sf_dir):
    """Groups too large to be taken whole, enclosed by their sketch first."""
    rows = percentile(read(spark, sf_dir, "lineitem"), ["l_returnflag"], 95, "l_extendedprice", "p95", accuracy=1000)
    return rows.select(F.col("l_returnflag").alias("flag"), "n", F.round("p95", 6).alias("p95"))


@query("""
WITH d AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS step FROM d),
c AS (SELECT *, sum(step) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s)
SELECT event_id, event_type AS name,
       round((total - first_value(total) OVER (PARTITION BY event_type ORDER BY ts
             RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)) / 300, 6) + 0.0 AS rate
FROM c""")
def rate5m(spark, sf_dir):
    points = event_points(spark, sf_dir).select("event_id", "name", "time_unix_nano", "value")
    return rate(points, 300, ("name",), "event_id").select(
        "event_id", "name", (F.round("rate", 6) + F.lit(0.0)).alias("rate")
    )


@query("""
WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events)
SELECT CAST(least(floor((value - lo) / w), 4) AS INTEGER) AS bin, count(*) AS n,
       round(min(lo + least(floor((value - lo) / w), 4) * w), 6) AS bin_from
FROM events, m GROUP BY 1""")
def value_histogram(spark, sf_dir):
    return histogram(event_points(spark, sf_dir), 5).select("bin", "n", F.round("bin_from", 6).alias("bin_from"))


@query("""
SELECT round(sum(value), 2) AS total, round(avg(value), 6) AS average, min(value) AS smallest, max(value) AS greatest
FROM events""")
def summary_stats(spark, sf_dir):
    return summary(event_points(spark, sf_dir)).select(
        F.round("total", 2).alias("total"), F.round("average", 6).alias("average"), "smallest", "greatest"
    )


@query("SELECT count(*) AS n FROM (SELECT 1 FROM events WHERE event_type = 'click' LIMIT 100)")
def counting_scan(spark, sf_dir):
    """Counting stops at a hundred matches."""
    hits = where_labels(event_points(spark, sf_dir), "metrics", {"__name__": "click"})
    return hits.select("event_id").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {NANOS} AS time_unix_nano, event_type AS name, value FROM events ORDER BY ts, value LIMIT 1000")
def earliest_points(spark, sf_dir):
    """The usual limit of a metric query: the earliest thousand points."""
    points = event_points(spark, sf_dir)
    return metric_points(points, start="2024-01-01T00:00:00Z", end="2024-02-01T00:00:00Z", limit=METRIC_LIMIT).select(
        "time_unix_nano", "name", "value"
    )


@query(f"SELECT {NANOS} AS time_unix_nano, value FROM events WHERE event_type = 'error' AND {WEEK} ORDER BY ts LIMIT 50")
def filter_then_limit(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return metric_points(points, "__name__=error", START, END, 50).select("time_unix_nano", "value")


@query(f"SELECT {NANOS} AS time_unix_nano, value FROM events WHERE event_type = 'error' AND {WEEK}")
def unlimited_points(spark, sf_dir):
    """Limit 0 keeps all."""
    points = event_points(spark, sf_dir)
    return metric_points(points, "__name__=error", START, END, 0).select("time_unix_nano", "value")


@query(f"""
WITH s AS (
  SELECT {KEY} AS series_key, CAST(epoch_us(date_trunc('hour', ts)) // 1000000 AS BIGINT) AS bucket, avg(value) AS v
  FROM events WHERE event_type = 'view' AND {WEEK} GROUP BY event_type, user_id, 1, 2
), l AS (SELECT * FROM s ORDER BY bucket, series_key LIMIT 1000)
SELECT series_key, CAST(count(*) AS BIGINT) AS n, round(sum(v), 4) AS total FROM l GROUP BY 1""")
def stepped_metric_query(spark, sf_dir):
    """A metric query with a step."""
    rows = metric_query(event_points(spark, sf_dir), "__name__=view", START, END, "1h", METRIC_LIMIT, chunk_seconds=None)
    total = F.aggregate("values", F.lit(0.0), lambda s, p: s + p["value"])
    return rows.select(
        "series_key", F.size("values").cast("bigint").alias("n"), F.round(total, 4).alias("total")
    )


@query(f"""
SELECT series_key, event_id, position FROM (
  SELECT {KEY} AS series_key, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS position
  FROM events) WHERE position <= 3""")
def first_n_per_series(spark, sf_dir):
    return first_per_series(event_points(spark, sf_dir), 3, ["event_id"]).select("series_key", "event_id", "position")


@query("""
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def dedup_last(spark, sf_dir):
    return keep_last(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""
SELECT CAST(epoch_us(l_shipdate) * 1000 AS BIGINT) AS time_unix_nano, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r
  FROM lineitem) WHERE r = 1""")
def overwrite_same_instant(spark, sf_dir):
    """Only the last of rows with equal time, as a store keyed by time keeps them."""
    rows = read(spark, sf_dir, "lineitem")
    last = keep_last(rows, ["l_shipdate"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return last.select(
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("time_unix_nano"), "l_orderkey", "l_linenumber"
    )
