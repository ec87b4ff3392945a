"""One key with a third of all rows: same results, and no task or array that grows with it."""

import pytest
from helpers import BASE_NANOS, SECOND, iso
from pyspark.sql import functions as F

from pulselake.operators.alerts import AlertRule, evaluate, metric_states
from pulselake.operators.distribution import percentile
from pulselake.operators.rate import rate
from pulselake.operators.series import downsample, latest_values, matrix
from pulselake.operators.traces import nested_events, nested_spans, spans, traces
from test_traces import span_points

ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    labels = F.create_map(F.lit("__name__"), F.lit("cpu"), F.lit("host"), key)
    at = F.lit(BASE_NANOS) + F.col("id") * (SECOND // 10)
    df = spark.range(0, ROWS, 1, 8).select(
        at.alias("time_unix_nano"), F.timestamp_micros((at / 1000).cast("bigint")).alias("ts"), F.lit("cpu").alias("name"),
        F.lit("svc").alias("service"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"),
        labels.alias("labels"), key.alias("host"),
    )
    return df.persist()


def test_matrix_keeps_every_point_in_short_arrays(hot):
    rows = matrix(hot, 600, max_values=500)
    sizes = rows.agg(F.sum(F.size("values")), F.max(F.size("values"))).first()
    assert tuple(sizes) == (ROWS, 500)


def test_rate_keeps_every_point_once(hot):
    source = hot.select("host", "time_unix_nano", "value")
    short, long = rate(source, 60, ("host",)), rate(source, 60, ("host",), segment_seconds=100_000)
    keys = ["host", "time_unix_nano"]
    assert short.count() == ROWS
    other = long.select(*keys, F.col("rate").alias("other"))
    assert short.join(other, keys).where(F.abs(F.col("rate") - F.col("other")) < 1e-9).count() == ROWS


def test_percentile_of_a_hot_group(hot):
    got = {r.host: r.percentile for r in percentile(hot, ["host"], 95, accuracy=100).collect()}
    want = {r.host: r.p for r in hot.groupBy("host").agg(F.percentile("value", 0.95).alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_groups_are_combined_before_the_shuffle(hot):
    for df in (latest_values(hot), downsample(hot, 60, by=("host",))):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in text.split("Exchange hashpartitioning")[1]


def test_alert_rows_are_reduced_before_they_are_spread(hot):
    rules = [AlertRule("r", "metrics", 300, selector={"__name__": "cpu"}, threshold=990.0)]
    states = metric_states(hot, rules, iso(0), iso(4000))
    text = states._jdf.queryExecution().executedPlan().toString()
    spread = text.index("explode(sequence(")
    assert text.index("partial_max_by", spread) > spread  # planned below, so run before
    assert states.count() >= 1


def test_alert_events_make_no_row_for_each_tick(hot):
    rules = [AlertRule("r", "metrics", 86_400, selector={"__name__": "cpu"}, threshold=990.0)]
    events = evaluate({"metrics": hot}, rules, iso(0), iso(4000))
    text = events._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in text and "partial_max_by" in text
    assert events.count() >= 1


def test_a_hot_trace_and_a_hot_event(spark):
    rows = [(i, "hot", f"s{i % 400}", "duration", {}) for i in range(800)]
    rows += [(5, "hot", "s1", "event", {"event": "e", "key": "n", "value": 1.0})] * 500
    rows += [(i, f"t{i}", "s", "duration", {}) for i in range(300)]
    points = span_points(spark, rows)
    span_rows = spans(points)
    nested = nested_spans(span_rows, traces(span_rows), part_size=50)
    assert tuple(nested.agg(F.sum(F.size("spans")), F.max("part")).first()) == (700, 7)
    (events,) = nested_events(points, span_rows, part_size=1000).collect()
    assert [e.copies for e in events.events] == [500]
