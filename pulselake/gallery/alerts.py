"""Alert rules and panels over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.gallery.registry import query
from pulselake.gallery.tables import event_logs, event_points, order_span_points
from pulselake.operators.alerts import (
    AlertRule, evaluate, join_rules, log_states, metric_states, new_alerts, rule_from_config, rule_table,
    rules_from_config, valid_rules,
)
from pulselake.operators.panels import Panel, find_panel, panel_table, panels_of_view
from pulselake.plans.queries import panel_rows
from pulselake.session import shared_folder

START, END = "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z"

METRIC_RULES = [
    rule_from_config({"name": "HighError", "dataSource": "metrics", "query": "__name__=error > 80",
                      "duration": "5m", "severity": "critical"}),
    rule_from_config({"name": "HighView", "dataSource": "metrics", "query": "__name__=view, service.name=user-8 > 20.5",
                      "duration": "1h30m", "severity": "warning"}),
    rule_from_config({"name": "AnyClick", "dataSource": "metrics", "query": "__name__=click",
                      "duration": "150s", "severity": "info"}),
]
LOG_RULES = [
    AlertRule("K7", "logs", 600, "warning", text='"K": 7}'),
    AlertRule("UserEight", "logs", 900, "warning", text="USER-88"),
]
TRACE_RULES = [
    AlertRule("Returned", "traces", 120, "critical", text="R/"),
    AlertRule("Supplier12", "traces", 3600, "warning", text="supplier-12"),
]

TICKS = """
ticks AS (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 MINUTE)) AS tick)"""
EDGES = """
edges AS (
  SELECT *, lag(tick) OVER (PARTITION BY rule_name ORDER BY tick) AS before FROM states
)
SELECT rule_name, severity, epoch_us(tick) // 60000000 AS tick, details,
       'Alert: ' || rule_name || ' triggered at ' || strftime(tick, '%Y-%m-%dT%H:%M:%SZ') || '. Details: ' || details AS body
FROM edges WHERE before IS NULL OR before < tick - INTERVAL 1 MINUTE"""
METRIC_STATES = """
rules(rule_name, severity, name, person, threshold, lookback) AS (VALUES
  ('HighError', 'critical', 'error', NULL, 80.0, INTERVAL 5 MINUTE),
  ('HighView', 'warning', 'view', 8, 20.5, INTERVAL 90 MINUTE),
  ('AnyClick', 'info', 'click', NULL, 0.0, INTERVAL 150 SECOND)),
newest AS (
  SELECT rule_name, severity, threshold, tick, user_id, arg_max(value, ts) AS value
  FROM events JOIN rules ON event_type = name AND coalesce(person, user_id) = user_id
  JOIN ticks ON ts BETWEEN tick - lookback AND tick GROUP BY ALL
),
states AS (
  SELECT rule_name, severity, tick,
         printf('Metric value %.2f exceeds threshold %.2f', max(value), threshold::DOUBLE) AS details
  FROM newest WHERE value > threshold GROUP BY rule_name, severity, tick, threshold
)"""
LOG_STATES = """
rules(rule_name, severity, wanted, lookback) AS (VALUES
  ('K7', 'warning', '"k": 7}', INTERVAL 10 MINUTE), ('UserEight', 'warning', 'user-88', INTERVAL 15 MINUTE)),
states AS (
  SELECT rule_name, severity, tick, 'Found ' || count(*) || ' logs matching the query' AS details
  FROM events JOIN rules ON contains(lower(props), wanted) OR contains('user-' || user_id, wanted)
  JOIN ticks ON ts BETWEEN tick - lookback AND tick GROUP BY rule_name, severity, tick
)"""
TRACE_STATES = """
rules(rule_name, severity, wanted, lookback) AS (VALUES
  ('Returned', 'critical', 'R/', INTERVAL 2 MINUTE), ('Supplier12', 'warning', 'supplier-12', INTERVAL 1 HOUR)),
hits AS (
  SELECT rule_name, severity, lookback, l_orderkey, l_shipdate FROM lineitem JOIN rules
  ON contains(l_returnflag || '/' || l_linestatus, wanted) OR contains('supplier-' || l_suppkey, wanted)
     OR contains(CAST(l_orderkey AS VARCHAR), wanted)
  WHERE l_shipdate BETWEEN TIMESTAMP '1996-12-31' AND TIMESTAMP '1997-04-01'
),
states AS (
  SELECT rule_name, severity, tick,
         'Found ' || count(DISTINCT l_orderkey) || ' traces matching the query' AS details
  FROM hits JOIN ticks ON l_shipdate BETWEEN tick - lookback AND tick GROUP BY rule_name, severity, tick
)"""
WEEK = TICKS.format(start="2024-01-05", end="2024-01-12")
QUARTER = TICKS.format(start="1997-01-01", end="1997-04-01")


def _minutes(events: DataFrame) -> DataFrame:
    return events.withColumn("tick", (F.unix_seconds("tick") / 60).cast("bigint"))


@query(f"WITH {WEEK}, {METRIC_STATES}, {EDGES}")
def alert_metric(spark, sf_dir):
    return _minutes(evaluate({"metrics": event_points(spark, sf_dir)}, METRIC_RULES, START, END))


@query(f"WITH {WEEK}, {LOG_STATES}, {EDGES}")
def alert_log(spark, sf_dir):
    return _minutes(evaluate({"logs": event_logs(spark, sf_dir)}, LOG_RULES, START, END))


@query(f"WITH {QUARTER}, {TRACE_STATES}, {EDGES}")
def alert_trace(spark, sf_dir):
    tables = {"traces": order_span_points(spark, sf_dir)}
    return _minutes(evaluate(tables, TRACE_RULES, "1997-01-01T00:00:00Z", "1997-04-01T00:00:00Z"))


@query(f"WITH {WEEK}, {METRIC_STATES} SELECT rule_name, epoch_us(tick) // 60000000 AS tick, details FROM states")
def alert_metric_states(spark, sf_dir):
    """Every triggered tick, before edges are found."""
    names = F.array(*[F.lit(r.name) for r in METRIC_RULES])
    states = metric_states(event_points(spark, sf_dir), METRIC_RULES, START, END)
    return states.select(F.get(names, F.col("rule")).alias("rule_name"), "tick", "details")


@query(f"""
WITH {WEEK}, {LOG_STATES}, e AS (SELECT *, lag(tick) OVER (PARTITION BY rule_name ORDER BY tick) AS before FROM states)
SELECT rule_name, count(*) AS alerts, min(epoch_us(tick) // 60000000) AS first_tick
FROM e WHERE before IS NULL OR before < tick - INTERVAL 1 MINUTE GROUP BY 1""")
def alert_edges(spark, sf_dir):
    """Alerts per rule."""
    names = F.array(*[F.lit(r.name) for r in LOG_RULES])
    edges = new_alerts(log_states(event_logs(spark, sf_dir), LOG_RULES, START, END))
    return edges.groupBy(F.get(names, F.col("rule")).alias("rule_name")).agg(
        F.count(F.lit(1)).alias("alerts"), F.min("tick").alias("first_tick")
    )


@query("""
SELECT CASE event_type WHEN 'error' THEN 'HighError' WHEN 'view' THEN 'HighView' ELSE 'AnyClick' END AS rule_name,
       count(*) AS points
FROM events WHERE event_type IN ('error', 'click') OR (event_type = 'view' AND user_id = 8) GROUP BY 1""")
def rules_join(spark, sf_dir):
    """Points with the rules of a rule table."""
    rules = valid_rules(rule_table(spark, METRIC_RULES + LOG_RULES))
    return join_rules(event_points(spark, sf_dir), rules).groupBy("rule_name").agg(F.count(F.lit(1)).alias("points"))


PANELS = [
    Panel("Errors", "metrics", "__name__=error", "6h"),
    Panel("Messages", "logs", "user-1", "45m", 10, "table"),
    Panel("Shipments", "traces", "R/F", "30d", 20, "table"),
    Panel("Unreadable refresh", "metrics", "", "soon"),
]
NOW = "2024-01-20T12:00:00.500Z"


@query("""
SELECT CAST(epoch_us(ts) * 1000 AS BIGINT) AS time_unix_nano, value FROM events
WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-20 12:00:00'
ORDER BY ts LIMIT 1000""")
def panel_metric(spark, sf_dir):
    rows = panel_rows({"metrics": event_points(spark, sf_dir)}, PANELS[0], NOW)
    return rows.select("time_unix_nano", "value")


@query("""
SELECT epoch_us(ts) AS at_us, props AS text FROM events
WHERE (contains(lower(props), 'user-1') OR contains('user-' || user_id, 'user-1'))
  AND ts BETWEEN TIMESTAMP '2024-01-20 04:30:00' AND TIMESTAMP '2024-01-20 12:00:00'
ORDER BY ts LIMIT 10""")
def panel_log(spark, sf_dir):
    rows = panel_rows({"logs": event_logs(spark, sf_dir)}, PANELS[1], NOW)
    return rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "text")


@query("""
WITH p AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_linenumber AS VARCHAR) AS span_id, l_shipdate AS ts,
         l_returnflag || '/' || l_linestatus AS name FROM lineitem
  WHERE contains(l_returnflag || '/' || l_linestatus, 'R/F')
    AND l_shipdate BETWEEN TIMESTAMP '1997-12-31' - INTERVAL 300 DAY AND TIMESTAMP '1997-12-31'
)
SELECT epoch_us(min(ts)) AS at_us, printf('%s (%.2fms)', arg_min(name, (ts, span_id)),
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE) AS text
FROM p GROUP BY trace_id ORDER BY min(ts) DESC, trace_id LIMIT 20""")
def panel_trace(spark, sf_dir):
    rows = panel_rows({"traces": order_span_points(spark, sf_dir)}, PANELS[2], "1997-12-31T00:00:00Z")
    return rows.select(F.unix_micros("ts").alias("at_us"), "text")


@query("""
SELECT 'Errors' AS title, count(*) AS n FROM events
WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-20 12:00:00'
UNION ALL
SELECT 'Unreadable refresh', count(*) FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-20 11:55:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def panel_view(spark, sf_dir):
    """Row counts of the panels of the metrics view, found through the panel table."""
    tables = {"metrics": event_points(spark, sf_dir)}
    shown = panels_of_view(panel_table(spark, PANELS), "metrics")
    counts = reduce(
        DataFrame.unionByName,
        [
            panel_rows(tables, p, NOW).agg(F.count(F.lit(1)).alias("n")).withColumn("title", F.lit(p.title))
            for p in PANELS if p.data_source == "metrics"
        ],
    )
    return counts.join(shown.select("title"), "title").select("title", "n")


# A configuration file in the form that rules are read from.
CONFIG = """{"alerts": {"rules": [
  {"name": "HighError", "dataSource": "metrics", "query": "__name__=error > 80", "duration": "5m", "severity": "critical"},
  {"name": "UserEight", "dataSource": "metrics", "query": "service.name=user-8", "duration": "90s", "severity": "info"},
  {"name": "Unreadable", "dataSource": "metrics", "query": "__name__=view > much", "duration": "1h"},
  {"name": "Words", "dataSource": "logs", "query": "K > 7", "duration": "10m", "severity": "warning"}]}}"""


@query("""
WITH r(rule_name, name, person, threshold, lookback_s, severity) AS (VALUES
  ('HighError', 'error', NULL, 80.0, 300, 'critical'), ('UserEight', NULL, 8, 0.0, 90, 'info'), ('Unreadable', 'view', NULL, 0.0, 3600, ''))
SELECT rule_name, lookback_s, coalesce(severity, '') AS severity, count(*) AS points, count(*) FILTER (WHERE value > threshold) AS high
FROM r JOIN events ON event_type = coalesce(name, event_type) AND user_id = coalesce(person, user_id) GROUP BY ALL""")
def rules_of_config(spark, sf_dir):
    """Points that meet the rules of a configuration file, and those of them over the rule's threshold."""
    path = shared_folder(spark, "config")
    spark.createDataFrame([(CONFIG,)], "value string").coalesce(1).write.text(path)
    rules = valid_rules(rule_table(spark, rules_from_config(spark, path)))
    joined = join_rules(event_points(spark, sf_dir), rules)
    return joined.groupBy("rule_name", F.col("lookback_s").cast("int").alias("lookback_s"), F.coalesce("severity", F.lit("")).alias("severity")).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("value") > F.col("threshold")).alias("high")
    )


@query("""
SELECT 'Errors' AS wanted, count(*) AS n, max(value) AS greatest FROM events
WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-20 12:00:00'
UNION ALL
SELECT '3', count(*), max(value) FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-20 11:55:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def panel_lookup(spark, sf_dir):
    """Panels found by title and by position, and what they show."""
    tables, panels = {"metrics": event_points(spark, sf_dir)}, panel_table(spark, PANELS)
    shown = []
    for wanted in ("Errors", "3"):
        p = find_panel(panels, wanted).first()
        rows = panel_rows(tables, Panel(p.title, p.data_source, p["query"], p.refresh_interval, p.max_rows, p.type), NOW)
        shown.append(rows.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("greatest")).withColumn("wanted", F.lit(wanted)))
    return reduce(DataFrame.unionByName, shown)
