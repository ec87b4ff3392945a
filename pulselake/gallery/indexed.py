"""Label filters and rules answered on the series index, text searches on the trigram index, steps of time on roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.gallery.registry import query
from pulselake.gallery.tables import event_logs, event_points
from pulselake.operators.series_index import (
    SeriesIndex, build_index, contains, equals, join_rules_by_index, matches, points_of, select_series, series_id,
)
from pulselake.operators.rollup import rolled, write_rollups
from pulselake.operators.text_index import index_texts, search_indexed
from pulselake.session import shared_folder
from pulselake.sinks.tables import append

K = "json_extract_string(props, '$.k')"


def indexed(spark, sf_dir):
    """Points with their series id, written, and the index of them."""
    path = shared_folder(spark, "indexed-points")
    event_points(spark, sf_dir, with_k=True).withColumn("series_id", series_id(F.col("labels"))).write.parquet(f"{path}/points")
    points = spark.read.parquet(f"{path}/points")
    return points, build_index(points, f"{path}/index")


@query(f"SELECT event_id, value FROM events WHERE event_type = 'error' AND {K} = '7'")
def index_selector(spark, sf_dir):
    points, index = indexed(spark, sf_dir)
    return points_of(points, select_series(index, equals("__name__", "error"), equals("k", "7"))).select("event_id", "value")


@query(f"""
SELECT event_id, value FROM events
WHERE regexp_full_match(event_type, 'click|view') AND regexp_full_match({K}, '[13]\\d?') AND contains('user-' || user_id, '-1')""")
def index_regex(spark, sf_dir):
    """Patterns are tried on the values that labels have, not on points."""
    points, index = indexed(spark, sf_dir)
    ids = select_series(index, matches("__name__", "click|view"), matches("k", r"[13]\d?"), contains("service.name", "-1"))
    return points_of(points, ids).select("event_id", "value")


@query(f"""
SELECT event_type AS name, 'user-' || user_id AS service, {K} AS k, count(*) AS points FROM events
WHERE event_type = 'purchase' AND user_id % 10 = 8 GROUP BY ALL""")
def index_series(spark, sf_dir):
    """Series and their sizes from the index alone."""
    _, index = indexed(spark, sf_dir)
    ids = select_series(index, equals("__name__", "purchase"), matches("service.name", r"user-\d*8"))
    label = F.col("labels")
    return index.series.join(ids, "series_id", "left_semi").select(
        label["__name__"].alias("name"), label["service.name"].alias("service"), label["k"].alias("k"), "points"
    )


def _rules(index: SeriesIndex):
    """A rule for each name and k that some series has, and one for each service: thousands, as rows."""
    names = index.series.select(F.col("labels")["__name__"].alias("a"), F.col("labels")["k"].alias("b")).where("b IS NOT NULL").distinct()
    by_name = names.select(F.concat_ws("/", "a", "b").alias("rule_name"), F.create_map(F.lit("__name__"), "a", F.lit("k"), "b").alias("selector"))
    services = index.series.select(F.col("labels")["service.name"].alias("a")).distinct()
    by_service = services.select(F.col("a").alias("rule_name"), F.create_map(F.lit("service.name"), "a").alias("selector"))
    every = index.series.sparkSession.range(1).select(
        F.lit("every").alias("rule_name"), F.map_filter(F.create_map(F.lit("x"), F.lit("x")), lambda k, v: F.lit(False)).alias("selector")
    )
    rest = {"data_source": F.lit("metrics"), "text": F.lit(""), "threshold": F.lit(50.0), "lookback_s": F.lit(300), "severity": F.lit("info")}
    return by_name.unionByName(by_service).unionByName(every).withColumns(rest)


@query(f"""
WITH p AS (SELECT event_type AS name, 'user-' || user_id AS service, {K} AS k, value FROM events),
r AS (
  SELECT DISTINCT name || '/' || k AS rule_name, name, k, NULL AS service FROM p WHERE k IS NOT NULL
  UNION ALL SELECT DISTINCT service, NULL, NULL, service FROM p
  UNION ALL SELECT 'every', NULL, NULL, NULL)
SELECT rule_name, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, max(value) AS greatest
FROM r JOIN p ON (r.name IS NULL OR r.name = p.name) AND (r.k IS NULL OR r.k = p.k) AND (r.service IS NULL OR r.service = p.service)
GROUP BY rule_name""")
def index_rules(spark, sf_dir):
    """Rules as rows: a series meets only those posted under one of its labels."""
    points, index = indexed(spark, sf_dir)
    joined = join_rules_by_index(points.select("series_id", "value"), index, _rules(index))
    return joined.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("threshold")).alias("high"), F.max("value").alias("greatest")
    )


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, props AS message FROM events
WHERE contains(lower(props), 'user-77') OR contains('user-' || user_id, 'user-77')""")
def index_log_search(spark, sf_dir):
    """A text search over the files that can hold the text."""
    path = shared_folder(spark, "indexed-logs")
    append(event_logs(spark, sf_dir).withColumn("dt", F.col("ts").cast("date")), path, "logs")
    index_texts(spark, path, f"{path}-trigrams")
    return search_indexed(spark, path, f"{path}-trigrams", "User-77").select("time_unix_nano", "message")


@query("""
SELECT event_type AS name, CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT) AS bucket, round(avg(value), 9) AS avg,
       min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum, count(value) AS count, arg_max(value, ts) AS latest
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-19' GROUP BY 1, 2""")
def rollup_1d(spark, sf_dir):
    """Two weeks by day from the daily roll-up, which is made from the hourly one, and that from minutes; written in two batches."""
    path, points = shared_folder(spark, "rollups"), event_points(spark, sf_dir)
    for batch, part in (("even", points.where("event_id % 2 = 0")), ("odd", points.where("event_id % 2 <> 0"))):
        write_rollups(part, path, batch, by=("name",))
    rows = rolled(spark, path, 86_400, "2024-01-05T00:00:00Z", "2024-01-19T00:00:00Z", by=("name",))
    return rows.select(
        "name", F.unix_seconds("bucket").alias("bucket"), F.round("avg", 9).alias("avg"), "min", "max", F.round("sum", 2).alias("sum"), "count", "latest"
    )
