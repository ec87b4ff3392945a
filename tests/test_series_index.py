"""The index of series against filters on the label maps, and the sweep of alert intervals against the states of every tick."""

import random

import pytest
from pyspark.sql import functions as F

from pulselake.functions.labels import label_match, label_match_map
from pulselake.operators import series_index as si
from pulselake.operators.alerts import (
    AlertRule, log_edges, log_states, metric_edges, metric_states, new_alerts, rule_from_config, rule_table, trace_edges, trace_states,
)

START = 1_704_067_200


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("index"))
    rows = []
    for i in range(600):
        labels = {k: f"{k}{rng.randrange(4)}" for k in ("a", "b", "c") if rng.random() < 0.8}
        rows.append((i, labels, float(i)))
    frame = spark.createDataFrame(rows, "n int, labels map<string,string>, value double")
    frame.withColumn("series_id", si.series_id(F.col("labels"))).write.parquet(f"{path}/points")
    points = spark.read.parquet(f"{path}/points")
    return points, si.build_index(points, f"{path}/index")


def numbers(frame):
    return sorted(r.n for r in frame.select("n").collect())


def test_selectors(indexed):
    points, index = indexed
    for wanted in ({}, {"a": "a1"}, {"a": "a1", "b": "b2"}, {"a": "a1", "b": "b2", "c": "c3"}, {"a": "none"}):
        ids = si.select_series(index, *[si.equals(k, v) for k, v in wanted.items()])
        assert numbers(si.points_of(points, ids)) == numbers(points.where(label_match(wanted)))
    twice = si.select_series(index, si.equals("a", "a1"), si.equals("a", "a2"))
    assert twice.collect() == []
    ids = si.select_series(index, si.matches("a", "a[12]"), si.contains("b", "3"))
    wanted = points.where(F.col("labels")["a"].rlike("^a[12]$") & F.contains(F.col("labels")["b"], F.lit("3")))
    assert numbers(si.points_of(points, ids)) == numbers(wanted) != []


def test_many_ids_and_the_label_map_stays_unread(indexed, monkeypatch):
    points, index = indexed
    ids = si.select_series(index, si.matches("a", ".*"))
    few = numbers(si.points_of(points, ids))
    monkeypatch.setattr(si, "BROADCAST_IDS", 3)
    frame = si.points_of(points, ids).select("n", "value")
    assert numbers(frame) == few
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/points" in line]
    assert scans and all("labels" not in line.split("ReadSchema")[1] for line in scans)


def test_ids_that_two_label_sets_share(spark, tmp_path):
    frame = spark.createDataFrame([(1, {"a": "x"}), (1, {"a": "y"})], "series_id bigint, labels map<string,string>")
    with pytest.raises(ValueError, match="another seed"):
        si.build_index(frame, str(tmp_path))


def test_rules_against_a_plain_join(spark, indexed):
    points, index = indexed
    selectors = [{"a": f"a{i % 5}", "b": f"b{i % 3}"} for i in range(40)] + [{"c": "c1"}, {}, {"zz": "1"}, {"a": "a0", "b": "b0", "c": "c0"}]
    rules = rule_table(spark, [AlertRule(f"r{i}", "metrics", 60, selector=s) for i, s in enumerate(selectors)] + [AlertRule("log", "logs", 60)])
    got = si.join_rules_by_index(points, index, rules).select("n", "rule_name").collect()
    plain = points.crossJoin(rules.where("data_source = 'metrics'")).where(label_match_map(F.col("selector"), F.col("labels")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain.select("n", "rule_name").collect()))
    posted = {r.rule_name: (r.label, r.value) for r in si.post_rules(index, rules).collect()}
    assert posted["r41"] == (si.ANY, si.ANY) and posted["r42"] == ("zz", "1")


def test_plan_does_not_grow_with_rules(spark, indexed):
    points, index = indexed
    plans = []
    for n in (2, 2000):
        rules = rule_table(spark, [AlertRule(f"r{i}", "metrics", 60, selector={"a": f"a{i}"}) for i in range(n)])
        plans.append(si.join_rules_by_index(points, index, rules)._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans[1]) < 2 * len(plans[0])


@pytest.mark.parametrize("seed", range(3))
def test_edges_equal_the_states(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(250):
        at = START + rng.choice([rng.randrange(-900, 7200), 60 * rng.randrange(120), rng.randrange(600)])
        rows.append((at * 10**9 + rng.randrange(3) * 500_000_000 + i, rng.choice("xy"), rng.choice(["s1", "s2", "s3"]), rng.uniform(0, 100)))
    frame = spark.createDataFrame(rows, "time_unix_nano bigint, name string, service string, value double").select(
        "*",
        F.timestamp_micros(F.expr("time_unix_nano div 1000")).alias("ts"),
        F.create_map(F.lit("__name__"), "name", F.lit("service.name"), "service").alias("labels"),
        F.concat(F.lit("found "), "service").alias("message"),
        F.concat(F.lit("t"), F.pmod("time_unix_nano", F.lit(7))).alias("trace_id"),
        F.lit("1").alias("span_id"),
        F.col("service").alias("span_name"),
    )
    start, end = "2024-01-01T00:00:10Z", "2024-01-01T01:30:00Z"
    metrics = [AlertRule("a", "metrics", s, selector={"__name__": "x"}, threshold=t) for s, t in ((300, 80), (30, 50), (150, 20), (86400, 95), (0, 1))]
    texts = [("s1", 300), ("s2", 45), ("s", 3600), ("nothing", 60)]
    logs = [AlertRule(t, "logs", s, text=t) for t, s in texts]
    traces = [AlertRule(t, "traces", s, text=t) for t, s in texts]
    for rules, edges, states in ((metrics, metric_edges, metric_states), (logs, log_edges, log_states), (traces, trace_edges, trace_states)):
        got = sorted(map(tuple, edges(frame, rules, start, end).select("rule", "tick", "details").collect()))
        assert got == sorted(map(tuple, new_alerts(states(frame, rules, start, end)).select("rule", "tick", "details").collect()))
        assert got


def test_a_label_with_two_values_is_an_error():
    entry = {"name": "n", "dataSource": "metrics", "query": "a=1, a=2 > 3", "duration": "5m"}
    with pytest.raises(ValueError, match="two values"):
        rule_from_config(entry)
    assert rule_from_config(entry | {"query": "a=1, a=1 > 3"}).selector == {"a": "1"}
