from datetime import datetime, timedelta, timezone

import pytest
from helpers import BASE_NANOS, iso, logs, plan, points
from pyspark.sql import functions as F

from pulselake.functions.labels import label_match, label_match_map, label_match_text, label_rlike, selector
from pulselake.functions.times import (
    between_nanos, duration_seconds, in_range, instant, query_range, store_range, ts_of_nanos, unix_nanos,
)
from pulselake.operators.logs import search
from pulselake.plans.queries import log_query, metric_points
from pulselake.sources.tables import where_labels


def three(spark):
    one = {"service": "test", "instance": "localhost", "metric": "test_metric1"}
    two = {**one, "metric": "test_metric2"}
    return points(spark, [(0, 42.0, one), (10, 43.5, one), (20, 44.2, two)])


def test_range_then_label(spark):
    df = three(spark)
    rows = in_range(df, iso(-60), iso(80))
    assert rows.count() == 3
    assert where_labels(rows, "metrics", "metric=test_metric1").count() == 2


def test_both_ends_are_included(spark):
    df = three(spark)
    assert in_range(df, iso(0), iso(20)).count() == 3
    assert in_range(df, iso(1), iso(19)).count() == 1
    assert df.where(between_nanos(iso(0), iso(20), strict=True)).count() == 1


def test_nanoseconds_count_at_the_ends(spark):
    df = points(spark, [(0, 1.0, {})]).withColumn("time_unix_nano", F.col("time_unix_nano") + 1)
    assert in_range(df, None, "2024-01-01T00:00:00Z").count() == 0
    assert in_range(df, "2024-01-01T00:00:00.000000001Z", "2024-01-01T00:00:00.000000001Z").count() == 1
    assert in_range(df, "2024-01-01T00:00:00.000000002Z", None).count() == 0


@pytest.mark.parametrize("text,kept", [
    ("metric=test_metric1", 2), (" metric = test_metric1 , junk, ", 2), ("service=test,instance=localhost", 3),
    ("metric=", 0), ("missing=x", 0), ("", 3), ("junk", 3), ("metric=test_metric1,metric=test_metric1", 2),
])
def test_selector_text(spark, text, kept):
    df = three(spark)
    assert df.where(label_match(text)).count() == kept
    assert df.where(label_match_text(F.lit(text), F.col("labels"))).count() == kept


def test_selector_splits_at_the_first_equals_sign():
    assert selector("a=b=c, d = e") == {"a": "b=c", "d": "e"}


def test_selector_map(spark):
    wanted = F.create_map(F.lit("metric"), F.lit("test_metric2"))
    assert three(spark).where(label_match_map(wanted, F.col("labels"))).count() == 1


def test_label_regex_is_anchored(spark):
    df = three(spark)
    assert df.where(label_rlike("metric", "test")).count() == 0
    assert df.where(label_rlike("metric", "test.*2|x")).count() == 1
    assert df.where(label_rlike("service", ".*")).count() == 3


def test_log_search(spark):
    df = logs(spark, [(0, "ERROR", "Connection LOST", {"k": "alpha"}), (1, "INFO", "ok", {"level": "Error-x"}),
                      (2, "ERROR", "ok", {"error": "v"}), (3, "INFO", "ok", {"a": "er", "b": "ror"})])
    assert search(df, "lost").count() == 1
    assert search(df, "ERROR").count() == 1  # a label value; neither the level nor a key
    assert search(df, "ALPHA").count() == 1
    assert search(df, "error\u0001x").count() == 0
    assert search(df, "").count() == 4


def test_log_query_filters_before_it_limits(spark):
    df = logs(spark, [(i, "INFO", "hit" if i % 2 else "miss", {}) for i in range(20)])
    rows = log_query(df, "hit", iso(0), iso(100), limit=5).collect()
    assert [(r.time_unix_nano - BASE_NANOS) // 10**9 for r in rows] == [1, 3, 5, 7, 9]
    assert log_query(df, "hit", iso(0), iso(100), limit=0).count() == 10


def test_default_ranges(spark):
    now = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    assert query_range(None, "", now) == (now - timedelta(hours=1), now)
    assert store_range(None, None, now)[0] == datetime(1970, 1, 1, tzinfo=timezone.utc)
    df = points(spark, [(i * 600, i, {}) for i in range(20)])
    assert metric_points(df, now=iso(7200)).count() == 7


@pytest.mark.parametrize("text", ["yesterday", "2024-01-01", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z"])
def test_bad_instants(text):
    with pytest.raises(ValueError):
        instant(text)


def test_instants():
    assert unix_nanos("2024-01-01T02:00:00.123456789+02:00") == BASE_NANOS + 123456789
    assert instant("2024-01-01T00:00:00Z").tzinfo == timezone.utc


@pytest.mark.parametrize("text,seconds", [("5m", 300), ("1h30m", 5400), ("30d", 2592000), ("250ms", 0.25), ("-2s", -2),
                                          ("1.5h", 5400), ("0", 0)])
def test_durations(text, seconds):
    assert duration_seconds(text) == seconds


@pytest.mark.parametrize("text", ["", "5", "soon", "1.5d", "5 m", "m5", "1h-2m"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_seconds(text)


def test_time_of_nanos_rounds_down(spark):
    df = spark.createDataFrame([(1999,), (-1,)], "n bigint")
    got = [r[0] for r in df.select(F.unix_micros(ts_of_nanos(F.col("n")))).collect()]
    assert got == [1, -1]


def test_filters_reach_the_parquet_reader(spark, tmp_path):
    from pulselake.operators.series import with_series_key
    from pulselake.sinks.tables import append
    from pulselake.sources.tables import read_table, scan

    df = with_series_key(points(spark, [(i * 3600, i, {"__name__": "cpu", "service.name": "s"}) for i in range(100)]))
    append(df.withColumn("dt", F.col("ts").cast("date")), str(tmp_path / "t"), "metrics")
    rows = where_labels(scan(read_table(spark, str(tmp_path / "t"), "metrics"), iso(0), iso(7200)), "metrics", "__name__=cpu")
    text = plan(rows.select("value"))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(name,cpu)" in pushed and "LessThanOrEqual(ts" in pushed and "time_unix_nano" in pushed
    assert "dt#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "labels" not in text.split("ReadSchema: ")[1].split("\n")[0]
    assert rows.count() == 3
