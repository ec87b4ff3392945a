import json

import pytest
from helpers import BASE, iso, logs, plan, points
from pyspark.sql import functions as F
from test_traces import span_points

from pulselake.operators.alerts import (
    AlertRule, evaluate, join_rules, match_rules, render, rule_from_config, rule_table, rules_from_config, valid_rules,
)
from pulselake.operators.panels import Panel, find_panel, panel_from_config, panel_range, panel_table, panels_of_view
from pulselake.plans.queries import panel_rows, result_json

CPU = {"__name__": "cpu_usage"}
RULE = rule_from_config({"name": "HighCPUUsage", "dataSource": "metrics", "query": "__name__=cpu_usage > 80",
                         "duration": "5m", "severity": "critical"})


def fired(spark, rows, rules=(RULE,), end=3600):
    events = evaluate({"metrics": points(spark, rows)}, list(rules), iso(0), iso(end))
    return [((r.tick.replace(tzinfo=BASE.tzinfo) - BASE).total_seconds() / 60, r.details) for r in events.orderBy("tick").collect()]


def test_rule_from_config():
    assert (RULE.selector, RULE.threshold, RULE.lookback_s) == (CPU, 80.0, 300)
    assert rule_from_config({"name": "x", "dataSource": "metrics", "query": "__name__=a >= 80", "duration": "5m"}).threshold == 0.0
    assert rule_from_config({"name": "x", "dataSource": "metrics", "query": "__name__=a", "duration": "5m"}).threshold == 0.0
    log = rule_from_config({"name": "x", "dataSource": "logs", "query": "level=ERROR", "duration": "10m", "severity": "w"})
    assert (log.text, log.lookback_s, log.severity) == ("level=ERROR", 600, "w")
    with pytest.raises(ValueError):
        rule_from_config({"name": "x", "dataSource": "logs", "query": "", "duration": "long"})
    with pytest.raises(ValueError):
        rule_from_config({"name": "x", "dataSource": "profiles", "query": "", "duration": "5m"})


def test_rules_from_a_config_file(spark, tmp_path):
    config = {"alerts": {"rules": [{"name": "A", "dataSource": "metrics", "query": "__name__=a > 1", "duration": "5m",
                                    "severity": "s"}]}}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    assert rules_from_config(spark, str(tmp_path / "c.json")) == [AlertRule("A", "metrics", 300, "s", {"__name__": "a"}, "", 1.0)]


def test_below_and_equal_do_not_fire(spark):
    assert fired(spark, [(30, 79, CPU), (600, 80, CPU)]) == []


def test_crossing_fires_once(spark):
    rows = [(30 + 60 * i, 85 + i, CPU) for i in range(10)]
    assert fired(spark, rows) == [(1.0, "Metric value 85.00 exceeds threshold 80.00")]


def test_newest_value_counts(spark):
    assert fired(spark, [(10, 99, CPU), (20, 10, CPU)]) == []
    assert fired(spark, [(10, 10, CPU), (20, 99, CPU), (130, 10, CPU)]) == [(1.0, "Metric value 99.00 exceeds threshold 80.00")]


def test_silence_resets(spark):
    assert [t for t, _ in fired(spark, [(30, 90, CPU), (30 + 1200, 95, CPU)])] == [1.0, 21.0]


def test_fall_and_rise_fires_again(spark):
    assert [t for t, _ in fired(spark, [(30, 90, CPU), (150, 10, CPU), (210, 91, CPU)])] == [1.0, 4.0]


def test_two_series_one_high(spark):
    rows = [(30, 90.126, {**CPU, "host": "a"}), (31, 10, {**CPU, "host": "b"})]
    assert fired(spark, rows) == [(1.0, "Metric value 90.13 exceeds threshold 80.00")]


def test_lookback_is_closed_at_both_ends(spark):
    rule = AlertRule("r", "metrics", 60, "s", CPU, threshold=80.0)
    rows = evaluate({"metrics": points(spark, [(60, 90, CPU)])}, [rule], iso(0), iso(600))
    assert [r.tick.minute for r in rows.collect()] == [1]  # active at minutes 1 and 2, new at 1
    assert [t for t, _ in fired(spark, [(0, 90, CPU), (180, 91, CPU)], [rule])] == [0.0, 3.0]
    assert [t for t, _ in fired(spark, [(0, 90, CPU), (120, 91, CPU)], [rule])] == [0.0]


def test_log_and_trace_rules(spark):
    tables = {
        "logs": logs(spark, [(30, "ERROR", "level=ERROR x", {}), (40, "ERROR", "other", {})] * 80),
        "traces": span_points(spark, [(1 + i, f"t{i % 3}", "s", "duration", {"name": "pay"}) for i in range(9)]),
    }
    rules = [AlertRule("L", "logs", 600, "w", text="LEVEL=error"), AlertRule("T", "traces", 60, "c", text="pay"),
             AlertRule("N", "traces", 60, "c", text="PAY"), AlertRule("Many", "logs", 600, "w")]
    rows = {r.rule_name: r for r in evaluate(tables, rules, iso(0), iso(120)).collect()}
    assert set(rows) == {"L", "T", "Many"}
    assert rows["L"].details == "Found 80 logs matching the query"
    assert rows["Many"].details == "Found 160 logs matching the query"
    assert rows["T"].details == "Found 3 traces matching the query"
    assert rows["T"].body == "Alert: T triggered at 2024-01-01T00:01:00Z. Details: Found 3 traces matching the query"


def test_template(spark):
    body = render("{severity}: {alertName} {timestamp} {details} {other}", F.lit("A"), F.lit("2024-01-01 00:00:01.5").cast("timestamp"),
                  F.lit("d"), F.lit("high"))
    assert spark.range(1).select(body).first()[0] == "high: A 2024-01-01T00:00:01Z d {other}"


def test_match_rules_gives_every_match_without_a_join(spark):
    rules = [RULE, AlertRule("all", "metrics", 60), AlertRule("b", "metrics", 60, selector={"host": "b"})]
    df = points(spark, [(0, 1, CPU), (1, 2, {"host": "b"})])
    matched = match_rules(df, rules)
    assert sorted((r.value, r.rule) for r in matched.collect()) == [(1.0, 0), (1.0, 1), (2.0, 1), (2.0, 2)]
    assert "Join" not in plan(matched)


def test_join_rules(spark):
    rules = [RULE, AlertRule("h", "metrics", 60, selector={**CPU, "host": "b"}), AlertRule("l", "logs", 60)]
    df = points(spark, [(0, 1, CPU), (1, 2, {**CPU, "host": "b"}), (2, 3, {"__name__": "x"})])
    table = rule_table(spark, rules)
    rows = join_rules(df, table).select("value", "rule_name").collect()
    assert sorted(map(tuple, rows)) == [(1.0, "HighCPUUsage"), (2.0, "HighCPUUsage"), (2.0, "h")]
    bad = table.withColumn("lookback_s", F.lit(-1).cast("bigint"))
    assert valid_rules(table).count() == 3 and valid_rules(bad).count() == 0


PANELS = [Panel("CPU Usage", "metrics", "__name__=cpu_usage", "30s"), Panel("1", "logs", "error", "1m", 2),
          Panel("Traces", "traces", "", "1m", 5)]


def test_panel_table(spark):
    table = panel_table(spark, PANELS)
    assert [r.title for r in find_panel(table, "2").collect()] == ["Traces"]
    assert [r.title for r in find_panel(table, "1").collect()] == ["1"]
    assert find_panel(table, "none").count() == 0
    assert panels_of_view(table, "overview").count() == 3
    assert [r.title for r in panels_of_view(table, "logs").collect()] == ["1"]
    assert panel_from_config({"title": "t", "dataSource": "logs"}) == Panel("t", "logs", "", "", 0, "")


def test_panel_range():
    start, end = panel_range(PANELS[0], "2024-01-01T00:10:00.9Z")
    assert (end - start).total_seconds() == 300 and end.microsecond == 0
    start, end = panel_range(Panel("x", "logs", refresh_interval="often"), iso(600))
    assert (end - start).total_seconds() == 300


def test_panel_rows(spark):
    tables = {
        "metrics": points(spark, [(i * 60, i, CPU) for i in range(20)]),
        "logs": logs(spark, [(i * 60, "ERROR", f"error {i}", {}) for i in range(20)]),
        "traces": span_points(spark, [(0, "t", "s", "duration", {"name": "op"}), (1.5, "t", "s", "status", {"name": "op"})]),
    }
    now = iso(660)
    assert panel_rows(tables, PANELS[0], now).count() == 6
    assert [r.text for r in panel_rows(tables, PANELS[1], now).collect()] == ["error 1", "error 2"]
    assert [r.text for r in panel_rows(tables, PANELS[2], iso(10)).collect()] == ["op (1.50ms)"]
    with pytest.raises(ValueError):
        panel_rows(tables, Panel("x", "profiles"), now)


def test_result_json(spark):
    df = points(spark, [(0, 1, {"k": "<a&b>"})]).select("value", "labels")
    assert result_json(df).first()[0] == '{"value":1.0,"labels":{"k":"<a&b>"}}'


def test_rules_without_a_name_join_by_their_first_label(spark):
    rows = points(spark, [(i, i, {"__name__": n, "host": h}) for i, (n, h) in enumerate([("cpu", "a"), ("cpu", "b"), ("mem", "a")])])
    rows = rows.unionByName(points(spark, [(9, 9, {"__name__": "cpu"})]))
    selectors = {"name": {"__name__": "cpu"}, "host": {"host": "a"}, "both": {"__name__": "cpu", "host": "a"}, "all": {}, "none": {"host": "z"},
                 "two": {"host": "b", "zone": "x"}}
    rules = rule_table(spark, [AlertRule(n, "metrics", 60, "info", s) for n, s in selectors.items()] + [AlertRule("log", "logs", 60, "info", text="x")])
    got = sorted((r.rule_name, int(r.value)) for r in join_rules(rows, rules).collect())
    assert got == [("all", 0), ("all", 1), ("all", 2), ("all", 9), ("both", 0), ("host", 0), ("host", 2), ("name", 0), ("name", 1), ("name", 9)]
    assert join_rules(rows, rules.limit(0)).count() == 0
    assert set(join_rules(rows, rules).columns) == set(rows.columns) | set(rules.columns)
