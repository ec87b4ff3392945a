"""Tables written to the shared folder and read back; streams run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulselake.functions.aggregates import named_aggregates
from pulselake.gallery.registry import query
from pulselake.gallery.tables import event_logs, event_points, gauge_requests, order_span_points
from pulselake.operators.alerts import AlertRule, rule_from_config
from pulselake.operators.series import with_series_key
from pulselake.session import shared_folder, state_partitions
from pulselake.sinks.tables import append, contract, retain_folder, unexpired, write_json
from pulselake.sources.tables import read_table, scan
from pulselake.streaming.alerts import alert_stream, use_state_store
from pulselake.streaming.downsample import downsample_stream
from pulselake.streaming.ingest import start_ingest, start_table

START, END = "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z"
WEEK = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"


def _dated(df):
    return df.withColumn("dt", F.col("ts").cast("date"))


@query(f"""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, 'user-' || user_id AS service, value,
       CAST(ts AS DATE)::VARCHAR AS dt FROM events WHERE {WEEK}""")
def metrics_table(spark, sf_dir):
    """Points written by day, then a time range read back."""
    path = shared_folder(spark, "metrics")
    append(_dated(with_series_key(event_points(spark, sf_dir))), path, "metrics")
    rows = scan(read_table(spark, path, "metrics", START, END), START, END)
    return rows.select("time_unix_nano", "name", "service", "value", F.col("dt").cast("string").alias("dt"))


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS name, count(*) AS n FROM events GROUP BY 1""")
def unknown_name(spark, sf_dir):
    """A point without a name is stored as unknown."""
    points = _dated(with_series_key(event_points(spark, sf_dir)))
    unnamed = points.withColumn("name", F.when(F.col("name") == "error", "").otherwise(F.col("name")))
    return contract(unnamed, "metrics").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, props AS message FROM events
WHERE event_type = 'error' AND {WEEK}""")
def logs_table(spark, sf_dir):
    path = shared_folder(spark, "logs")
    append(_dated(event_logs(spark, sf_dir)), path, "logs")
    rows = scan(read_table(spark, path, "logs", START, END), START, END).where("level = 'ERROR'")
    return rows.select("time_unix_nano", "message")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id, l_quantity AS value
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01'""")
def spans_table(spark, sf_dir):
    path = shared_folder(spark, "traces")
    append(_dated(order_span_points(spark, sf_dir)), path, "traces")
    january = ("1997-01-01T00:00:00Z", "1997-02-01T00:00:00Z")
    rows = scan(read_table(spark, path, "traces", *january), *january)
    return rows.select("trace_id", "span_id", "value")


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def json_sink(spark, sf_dir):
    """Rows as JSON lines, read back."""
    path = shared_folder(spark, "json")
    write_json(event_points(spark, sf_dir).select("name", "labels", "value"), path)
    rows = spark.read.schema("name string, labels map<string,string>, value double").json(path)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-25 06:00:00' - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    """Rows inside the retention of seven days."""
    return unexpired(event_points(spark, sf_dir), "metrics", "2024-01-25T06:00:00Z", "7d").select("event_id", "value")


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, value FROM events
WHERE ts >= TIMESTAMP '2024-01-25 06:00:00' - INTERVAL 7 DAY""")
def retention_folder(spark, sf_dir):
    """A table folder after the retention job."""
    path = shared_folder(spark, "retained")
    append(_dated(with_series_key(event_points(spark, sf_dir))), path, "metrics")
    retain_folder(spark, path, "metrics", "2024-01-25T06:00:00Z", "7d")
    return read_table(spark, path, "metrics").select("time_unix_nano", "name", "value")


def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(spark, rows, path, checkpoint):
    """Runs a stateful stream until its input is used up."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    with state_partitions(spark):
        started = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def _point_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    ts = F.col("ts").cast("timestamp")
    return events.select(
        (F.unix_micros(ts) * 1000).alias("time_unix_nano"),
        ts.alias("ts"),
        F.col("event_type").alias("name"),
        user.alias("service"),
        "value",
        F.lit("gauge").alias("point_kind"),
        F.create_map(F.lit("__name__"), F.col("event_type"), F.lit("service.name"), user).alias("labels"),
        ts.cast("date").alias("dt"),
    )


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, value,
       '{"__name__":"' || event_type || '","host":"host-' || event_type || '","k":"","service.name":"user-' || user_id || '"}'
         AS series_key
FROM events""")
def stream_ingest(spark, sf_dir):
    """Request files ingested as a stream, the table read afterwards."""
    inbox, path, checkpoint = (shared_folder(spark, f"ingest-{p}") for p in ("inbox", "points", "checkpoint"))
    gauge_requests(spark, sf_dir).write.text(inbox)
    bodies = spark.readStream.option("maxFilesPerTrigger", 4).text(inbox)
    start_ingest(bodies, "metrics", path, checkpoint, available_now=True).awaitTermination()
    return read_table(spark, path, "metrics").select("time_unix_nano", "name", "value", "series_key")


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, event_type AS name, value, CAST(ts AS DATE)::VARCHAR AS dt
FROM events""")
def stream_table(spark, sf_dir):
    """A stream of points appended to a table by day."""
    path, checkpoint = shared_folder(spark, "stream-points"), shared_folder(spark, "stream-checkpoint")
    points = contract(with_series_key(_point_stream(spark, sf_dir)), "metrics")
    start_table(points, path, checkpoint, available_now=True).awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select("time_unix_nano", "name", "value", F.col("dt").cast("string").alias("dt"))


@query("""
WITH w AS (
  SELECT event_type AS name, epoch_us(date_trunc('hour', ts)) // 1000000 AS bucket, value FROM events
)
SELECT name, CAST(bucket AS BIGINT) AS bucket, round(sum(value), 2) AS sum, count(value) AS count FROM w
GROUP BY 1, 2 HAVING bucket + 3600 <= (SELECT epoch_ms(max(ts)) / 1000 - 600 FROM events)""")
def stream_downsample(spark, sf_dir):
    """Hourly aggregates of a stream; hours the watermark has not passed are still open."""
    path, checkpoint = shared_folder(spark, "stream-hours"), shared_folder(spark, "stream-hours-checkpoint")
    hours = downsample_stream(
        _point_stream(spark, sf_dir), "1 hour", by=("name",), aggregates=named_aggregates(["sum", "count"])
    )
    _run(spark, hours, path, checkpoint)
    rows = spark.read.schema(hours.schema).parquet(path)
    return rows.select("name", F.unix_seconds("bucket").alias("bucket"), F.round("sum", 2).alias("sum"), "count")


def _stream_rules(lookback_s: int) -> list[AlertRule]:
    config = {"name": "HighError", "dataSource": "metrics", "query": "__name__=error > 80", "duration": f"{lookback_s}s"}
    eight = {"__name__": "click", "service.name": "user-8"}
    return [rule_from_config(config | {"severity": "critical"}), AlertRule("ClickOfEight", "metrics", lookback_s, "info", eight)]


STREAM_ALERTS = """
WITH ticks AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 MINUTE)) AS tick
),
rules(rule_name, severity, name, person, threshold) AS (VALUES
  ('HighError', 'critical', 'error', NULL, 80.0), ('ClickOfEight', 'info', 'click', 8, 0.0)),
newest AS (
  SELECT rule_name, severity, threshold, tick, user_id, arg_max(value, ts) AS value
  FROM events JOIN rules ON event_type = name AND coalesce(person, user_id) = user_id
  JOIN ticks ON ts >= tick - to_seconds({seconds}) AND ts < tick
  WHERE tick <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
  GROUP BY ALL
),
states AS (
  SELECT rule_name, severity, tick,
         printf('Metric value %.2f exceeds threshold %.2f', max(value), threshold::DOUBLE) AS details
  FROM newest WHERE value > threshold GROUP BY rule_name, severity, tick, threshold
),
edges AS (SELECT *, lag(tick) OVER (PARTITION BY rule_name ORDER BY tick) AS before FROM states)
SELECT rule_name, severity, epoch_us(tick) // 60000000 AS tick, details FROM edges
WHERE before IS NULL OR before < tick - INTERVAL 1 MINUTE"""


def _stream_alerts(spark, sf_dir, lookback_s: int):
    use_state_store(spark)
    path, checkpoint = shared_folder(spark, "stream-alerts"), shared_folder(spark, "stream-alerts-checkpoint")
    events = alert_stream(_point_stream(spark, sf_dir), _stream_rules(lookback_s))
    _run(spark, events, path, checkpoint)
    rows = spark.read.schema(events.schema).parquet(path)
    return rows.select("rule_name", "severity", (F.unix_seconds("tick") / 60).cast("bigint").alias("tick"), "details")


@query(STREAM_ALERTS.format(seconds=300))
def stream_alerts(spark, sf_dir):
    """Alerts of a stream of points, from sliding windows and an edge detector with state per rule."""
    return _stream_alerts(spark, sf_dir, 300)


@query(STREAM_ALERTS.format(seconds=150))
def stream_alerts_odd_lookback(spark, sf_dir):
    """A lookback that is no multiple of a minute: windows still end on whole minutes."""
    return _stream_alerts(spark, sf_dir, 150)


@query(STREAM_ALERTS.format(seconds=30))
def stream_alerts_short_lookback(spark, sf_dir):
    """A lookback of half a minute: only rows near the end of a minute count."""
    return _stream_alerts(spark, sf_dir, 30)
