"""Alert rules over metrics, logs and traces: every tick of a time range in one pass.

A rule looks back from each whole minute over ``[tick - lookback, tick]``. Rows are not joined with ticks. For events,
each row stands for the interval of ticks it counts for; intervals of a rule are merged in order, and a tick is made only
where a merged one begins, so the work does not grow with the lookback. The states of every tick, for which rows that
count for the same ticks are reduced to one and then spread, are a query of their own. All rules of a source share one scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulselake.functions.aggregates import latest
from pulselake.functions.labels import label_match, label_match_map, selector_pairs
from pulselake.functions.text import has_identity, log_text, trace_text
from pulselake.functions.times import div, duration_seconds, in_range, instant, rfc3339, unix_nanos
from pulselake.operators.series import NANOS, with_series_key
from pulselake.sources.tables import PROMOTED

SOURCES = ("metrics", "logs", "traces")
TICK_SECONDS = 60
TICK_NANOS = TICK_SECONDS * NANOS

# The details texts of alerts.
METRIC_DETAILS = "Metric value %.2f exceeds threshold %.2f"
FOUND_DETAILS = {"logs": "Found %d logs matching the query", "traces": "Found %d traces matching the query"}

# Fixed value: the body of an alert without a template of its own.
DEFAULT_TEMPLATE = "Alert: {alertName} triggered at {timestamp}. Details: {details}"


@dataclass(frozen=True)
class AlertRule:
    name: str
    data_source: str
    lookback_s: int
    severity: str = "warning"
    selector: dict[str, str] = field(default_factory=dict)
    text: str = ""
    threshold: float = 0.0

    def __post_init__(self):
        if self.data_source not in SOURCES:
            raise ValueError(f"rule {self.name}: unsupported data source {self.data_source!r}")


def rule_from_config(entry: dict) -> AlertRule:
    """A rule from its configuration entry: name, dataSource, query, duration, severity.

    A metric query is ``labels > threshold``; a threshold that is missing or unreadable is 0. The query of
    other sources is the text to search. ``duration`` is the lookback.
    """
    query, lookback = entry["query"], math.floor(duration_seconds(entry["duration"]))
    labels, text, threshold = {}, "", 0.0
    if entry["dataSource"] == "metrics":
        sides = query.split(">")
        pairs = selector_pairs(sides[0])
        labels = dict(pairs)
        if any(labels[key] != value for key, value in pairs):
            raise ValueError(f"rule {entry['name']}: one label with two values, which nothing can match")
        if len(sides) == 2:
            try:
                threshold = float(sides[1].strip())
            except ValueError:
                threshold = 0.0
    else:
        text = query
    return AlertRule(entry["name"], entry["dataSource"], lookback, entry.get("severity", ""), labels, text, threshold)


def rules_from_config(spark: SparkSession, path: str) -> list[AlertRule]:
    """The rules listed under ``alerts.rules`` of a configuration file, a short list by its nature."""
    text = spark.read.text(path, wholetext=True).select(
        F.from_json(
            "value",
            "alerts struct<rules: array<struct<name: string, dataSource: string, query: string, duration: string, severity: string>>>",
        ).alias("c")
    )
    rows = text.select("c.alerts.rules").first()
    return [rule_from_config(r.asDict()) for r in (rows[0] or [])] if rows else []


def rule_table(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    columns = {
        "rule_name": [r.name for r in rules],
        "data_source": [r.data_source for r in rules],
        "selector": pa.array([list(r.selector.items()) for r in rules], pa.map_(pa.string(), pa.string())),
        "text": [r.text for r in rules],
        "threshold": [float(r.threshold) for r in rules],
        "lookback_s": [int(r.lookback_s) for r in rules],
        "severity": [r.severity for r in rules],
    }
    return spark.createDataFrame(pa.table(columns))


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules with a known source and a readable, not negative lookback."""
    return rules.where(F.col("data_source").isin(*SOURCES) & (F.col("lookback_s") >= 0))


def join_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points with each metric rule of a rule table they match.

    A rule is posted under its metric name, else under the first label of its selector, else under nothing; a point is joined
    with the rules posted under its own values of these labels, and the rest of the selector is checked then. Spark
    broadcasts the rule table if its measured size allows, and shuffles it otherwise.
    """
    selector = F.col("selector")
    label = F.when(selector["__name__"].isNotNull(), "__name__").otherwise(F.coalesce(F.array_min(F.map_keys(selector)), F.lit("")))
    rules = valid_rules(rules).where("data_source = 'metrics'").withColumn("_label", label)
    rules = rules.withColumn("_value", F.coalesce(selector[F.col("_label")], F.lit("")))
    names = [r[0] for r in rules.select("_label").distinct().orderBy("_label").collect()]  # names of labels, not values
    value = {"": F.lit(""), "__name__": F.col("name")}
    own = [F.struct(F.lit(n).alias("_label"), value.get(n, F.col("labels")[n]).alias("_value")) for n in names or [""]]
    met = points.select("*", F.explode(F.array(*own)).alias("_own")).select("*", "_own.*").drop("_own")
    joined = met.where(F.col("_value").isNotNull()).join(rules, ["_label", "_value"])
    return joined.where(label_match_map(selector, F.col("labels"))).drop("_label", "_value")


def _condition(rule: AlertRule, columns: list[str]) -> Column:
    if rule.data_source == "metrics":
        promoted = {k: c for k, c in PROMOTED["metrics"].items() if c in columns}
        return label_match(rule.selector, promoted=promoted)
    if rule.data_source == "logs":
        return log_text(rule.text)
    return has_identity() & trace_text(rule.text)


def match_rules(df: DataFrame, rules: list[AlertRule], watermarked: str | None = None) -> DataFrame:
    """One row per row and matching rule, with the rule's position as ``rule``; no join.

    The rules are literals of the plan, so their common filter is pushed into the scan. On a stream
    ``watermarked`` names the event-time column: rows that match no rule must still move the watermark, and
    Spark keeps a condition above the watermark only if it reads that column.
    """
    conditions = [_condition(r, df.columns) for r in rules]
    if watermarked:
        conditions = [c & (F.col(watermarked) > F.lit("0001-01-02")) for c in conditions]
    matching = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    kept = df if watermarked else df.where(reduce(or_, conditions))
    return kept.select("*", F.explode(matching).alias("rule"))


def of_rule(values: list, rule: Column | str = "rule") -> Column:
    """The literal belonging to a rule's position."""
    rule = F.col(rule) if isinstance(rule, str) else rule
    return F.get(F.array(*[F.lit(v) for v in values]), rule)


def _with_ticks(df: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Matching rows with the first and last tick (minutes since the epoch) they count for."""
    longest = max(r.lookback_s for r in rules)
    first_tick = -(-unix_nanos(start) // TICK_NANOS)
    last_tick = unix_nanos(end) // TICK_NANOS
    at = F.col("time_unix_nano")
    lookback = of_rule([r.lookback_s * NANOS for r in rules])
    return (
        match_rules(in_range(df, instant(start) - timedelta(seconds=longest), end), rules)
        .withColumn("_from", F.greatest(div(at + (TICK_NANOS - 1), TICK_NANOS), F.lit(first_tick)))
        .withColumn("_to", F.least(div(at + lookback, TICK_NANOS), F.lit(last_tick)))
        .where("_from <= _to")
    )


def _spread(reduced: DataFrame) -> DataFrame:
    return reduced.withColumn("tick", F.explode(F.sequence("_from", "_to")))


def metric_states(points: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Triggered ticks of metric rules: any series whose newest value exceeds the threshold."""
    rows = _with_ticks(with_series_key(points), rules, start, end)
    reduced = rows.groupBy("rule", "series_key", "_from", "_to").agg(
        latest().alias("value"), F.max("time_unix_nano").alias("at")
    )
    per_series = (
        _spread(reduced)
        .groupBy("rule", "tick", "series_key")
        .agg(latest("value", "at").alias("value"))
    )
    threshold = of_rule([float(r.threshold) for r in rules])
    return (
        per_series.where(F.col("value") > threshold)
        .groupBy("rule", "tick")
        .agg(F.max("value").alias("value"))
        .select("rule", "tick", metric_details(F.col("value"), threshold).alias("details"))
    )


def log_states(logs: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Triggered ticks of log rules: at least one matching row."""
    reduced = _with_ticks(logs, rules, start, end).groupBy("rule", "_from", "_to").agg(F.count(F.lit(1)).alias("n"))
    return (
        _spread(reduced)
        .groupBy("rule", "tick")
        .agg(F.sum("n").alias("n"))
        .select("rule", "tick", found_details(F.col("n"), "logs").alias("details"))
    )


def trace_states(span_points: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Triggered ticks of trace rules: at least one matching trace."""
    reduced = _with_ticks(span_points, rules, start, end).select("rule", "trace_id", "_from", "_to").distinct()
    return (
        _spread(reduced)
        .select("rule", "tick", "trace_id")
        .distinct()
        .groupBy("rule", "tick")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("rule", "tick", found_details(F.col("n"), "traces").alias("details"))
    )


def _intervals(df: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Matching rows with the first and last tick they count for, both not yet cut to the range."""
    longest, at = max(r.lookback_s for r in rules), F.col("time_unix_nano")
    lookback = of_rule([r.lookback_s * NANOS for r in rules])
    return (
        match_rules(in_range(df, instant(start) - timedelta(seconds=longest), end), rules)
        .withColumn("_from", div(at + (TICK_NANOS - 1), TICK_NANOS))
        .withColumn("_to", div(at + lookback, TICK_NANOS))
        .where("_from <= _to")
    )


def _cut(rows: DataFrame, start, end) -> DataFrame:
    """The intervals within the ticks of the range."""
    first, last = -(-unix_nanos(start) // TICK_NANOS), unix_nanos(end) // TICK_NANOS
    cut = rows.withColumn("_from", F.greatest("_from", F.lit(first))).withColumn("_to", F.least("_to", F.lit(last)))
    return cut.where("_from <= _to")


def _begins(by_start: DataFrame) -> DataFrame:
    """Of (rule, _from, _to, ...), a row for each rule and first tick, those that no earlier interval reaches or touches.

    What counts for the tick at which a merged interval begins, begins there.
    """
    before = F.max("_to").over(Window.partitionBy("rule").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    return by_start.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("_from") - 1))


def metric_edges(points: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Ticks at which metric rules turn active.

    Of a series only the newest row of each minute counts; it does until its lookback ends or a newer one comes.
    """
    rows = _intervals(with_series_key(points), rules, start, end)
    panes = rows.groupBy("rule", "series_key", "_from").agg(
        latest().alias("value"), F.max_by("_to", "time_unix_nano").alias("_to")
    )
    newer = F.lead("_from").over(Window.partitionBy("rule", "series_key").orderBy("_from"))
    threshold = of_rule([float(r.threshold) for r in rules])
    high = panes.withColumn("_to", F.least("_to", newer - 1)).where(F.col("value") > threshold)
    by_start = _cut(high, start, end).groupBy("rule", "_from").agg(F.max("_to").alias("_to"), F.max("value").alias("value"))
    return _begins(by_start).select("rule", F.col("_from").alias("tick"), metric_details(F.col("value"), threshold).alias("details"))


def log_edges(logs: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Ticks at which log rules turn active."""
    rows = _cut(_intervals(logs, rules, start, end), start, end)
    by_start = rows.groupBy("rule", "_from").agg(F.max("_to").alias("_to"), F.count(F.lit(1)).alias("n"))
    return _begins(by_start).select("rule", F.col("_from").alias("tick"), found_details(F.col("n"), "logs").alias("details"))


def trace_edges(span_points: DataFrame, rules: list[AlertRule], start, end) -> DataFrame:
    """Ticks at which trace rules turn active."""
    rows = _cut(_intervals(span_points, rules, start, end), start, end)
    traces = rows.groupBy("rule", "_from", "trace_id").agg(F.max("_to").alias("_to"))
    by_start = traces.groupBy("rule", "_from").agg(F.max("_to").alias("_to"), F.count(F.lit(1)).alias("n"))
    return _begins(by_start).select("rule", F.col("_from").alias("tick"), found_details(F.col("n"), "traces").alias("details"))


def metric_details(value: Column, threshold: Column) -> Column:
    return F.format_string(METRIC_DETAILS, value, threshold)


def found_details(n: Column, what: str) -> Column:
    return F.format_string(FOUND_DETAILS[what], n)


def new_alerts(states: DataFrame) -> DataFrame:
    """Ticks at which a rule turns active. A tick without a triggered row before it is a reset.

    The window orders a rule's triggered ticks, at most one row a minute however many rows were read.
    """
    before = F.lag("tick").over(Window.partitionBy("rule").orderBy("tick"))
    return states.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") < F.col("tick") - 1)
    ).drop("_before")


def render(template: str, name: Column, tick: Column, details: Column, severity: Column) -> Column:
    body = F.lit(template)
    for placeholder, value in (
        ("{alertName}", name), ("{timestamp}", rfc3339(tick)), ("{details}", details), ("{severity}", severity),
    ):
        body = F.replace(body, F.lit(placeholder), value)
    return body


def to_events(rows: DataFrame, rules: list[AlertRule], template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``alert_events`` rows from rule positions and ticks in minutes."""
    named = rows.select(
        of_rule([r.name for r in rules]).alias("rule_name"),
        of_rule([r.severity for r in rules]).alias("severity"),
        F.timestamp_seconds(F.col("tick") * TICK_SECONDS).alias("tick"),
        "details",
    )
    return named.withColumn(
        "body", render(template, F.col("rule_name"), F.col("tick"), F.col("details"), F.col("severity"))
    )


EVENTS = "rule_name string, severity string, tick timestamp, details string, body string"
EDGES = {"metrics": metric_edges, "logs": log_edges, "traces": trace_edges}


def evaluate(
    tables: dict[str, DataFrame], rules: list[AlertRule], start, end, template: str = DEFAULT_TEMPLATE
) -> DataFrame:
    """Alert events of all rules for the whole minutes in ``[start, end]``.

    ``tables`` holds a frame per source in use. Rules start out inactive; without rules there are no events.
    """
    start, end = instant(start), instant(end)
    parts = []
    for source, edges in EDGES.items():
        mine = [r for r in rules if r.data_source == source]
        if mine:
            parts.append(to_events(edges(tables[source], mine, start, end), mine, template))
    if not parts:
        return SparkSession.active().createDataFrame([], EVENTS)
    return reduce(DataFrame.unionByName, parts)
