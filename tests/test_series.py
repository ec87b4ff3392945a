import random

import pytest
from helpers import BASE_NANOS, SECOND, exchanges, iso, plan, points
from pyspark.sql import functions as F

from pulselake.functions.aggregates import named_aggregates, percentile_estimate
from pulselake.operators.dedup import keep_last
from pulselake.operators import distribution
from pulselake.operators.distribution import histogram, percentile
from pulselake.operators.panels import first_of_selectors
from pulselake.operators.rate import rate
from pulselake.operators.series import (
    above_threshold, downsample, first_per_series, label_stats, latest_values, matrix, series,
)
from pulselake.plans.queries import metric_query


def benchmark_rows(spark, n, base=0):
    """Rows i with level i mod 4, component i mod 3; value i."""
    i = F.col("id")
    return spark.range(base, base + n).select(
        (F.lit(BASE_NANOS) + (i % 3600) * SECOND).alias("time_unix_nano"),
        F.timestamp_seconds(F.lit(BASE_NANOS // SECOND) + i % 3600).alias("ts"),
        i.cast("double").alias("value"),
        F.concat(F.lit("level_"), (i % 4).cast("string")).alias("level"),
        F.concat(F.lit("component_"), (i % 3).cast("string")).alias("component"),
        F.create_map(
            F.lit("stacktrace"), F.concat(i.cast("string"), F.lit(": System.Threading.Tasks.TaskCanceledException"))
        ).alias("labels"),
    )


def test_group_by_level(spark):
    rows = label_stats(benchmark_rows(spark, 100_000, 900_000), "level").collect()
    assert {(r.level, r.n, r.sum_value) for r in rows} == {
        ("level_0", 25000, 23749950000.0), ("level_1", 25000, 23749975000.0), ("level_2", 25000, 23750000000.0),
        ("level_3", 25000, 23750025000.0)}


def test_two_label_lookup_and_substring(spark):
    rows = benchmark_rows(spark, 100_000, 900_000)
    assert rows.where("level = 'level_1' AND component = 'component_2'").count() in (8333, 8334)
    wanted = "1000: System.Threading.Tasks.TaskCanceledException"
    assert rows.where(F.contains(F.col("labels")["stacktrace"], F.lit(wanted))).count() == 10


def test_series_ignore_label_order(spark):
    df = points(spark, [(0, 1, {"a": "1", "b": "2"}), (1, 2, {"b": "2", "a": "1"}), (2, 3, {"a": "1"})])
    rows = {r.series_key: (r.points, r.labels) for r in series(df).collect()}
    assert rows == {'{"a":"1","b":"2"}': (2, {"a": "1", "b": "2"}), '{"a":"1"}': (1, {"a": "1"})}


def test_latest_and_threshold(spark):
    df = points(spark, [(5, 10, {"s": "a"}), (1, 99, {"s": "a"}), (3, 80, {"s": "b"}), (2, 1, {"s": "b"})])
    assert {r.series_key: r.latest for r in latest_values(df).collect()} == {'{"s":"a"}': 10.0, '{"s":"b"}': 80.0}
    assert above_threshold(df, 10).count() == 1 and above_threshold(df, 80).count() == 0
    assert "SortAggregate" not in plan(latest_values(df))


def test_matrix_is_cut_into_stretches_and_parts(spark):
    df = points(spark, [(i * 0.25, i, {"s": "a"}) for i in range(100)] + [(3601, 5, {"s": "a"}), (2, 7, {"s": "b"})])
    rows = matrix(df, 3600, max_values=40).orderBy("series_key", "chunk_start", "part").collect()
    sizes = [(r.series_key, r.chunk_start - BASE_NANOS // SECOND, r.part, len(r["values"])) for r in rows]
    assert sizes == [('{"s":"a"}', 0, 0, 40), ('{"s":"a"}', 0, 1, 40), ('{"s":"a"}', 0, 2, 20), ('{"s":"a"}', 3600, 0, 1),
                     ('{"s":"b"}', 0, 0, 1)]
    joined = [v.value for r in rows[:3] for v in r["values"]]
    assert joined == [float(i) for i in range(100)]
    assert rows[0]["values"][5].unix_seconds == float(BASE_NANOS // SECOND + 1)
    assert exchanges(matrix(df)) == 1


def test_metric_query_limits_points(spark):
    df = points(spark, [(i, i, {"s": str(i % 3)}) for i in range(2000)])
    rows = metric_query(df, "", iso(0), iso(5000), limit=1000, chunk_seconds=None).collect()
    assert sorted(len(r["values"]) for r in rows) == [333, 333, 334]
    rows = metric_query(df, "", iso(0), iso(5000)).collect()
    assert sum(len(r["values"]) for r in rows) == 2000
    rows = metric_query(df, "s=1", iso(0), iso(5000), step="100s", limit=0).collect()
    values = sorted(v for r in rows for v in r["values"])
    assert len(values) == 20 and values[0].value == sum(i for i in range(100) if i % 3 == 1) / 33


def test_downsample_boundaries(spark):
    df = points(spark, [(0, 1, {"s": "a"}), (59.999, 3, {"s": "a"}), (60, 5, {"s": "a"})])
    rows = downsample(df, 60, named_aggregates(["sum", "count"])).orderBy("bucket").collect()
    assert [(r["sum"], r["count"]) for r in rows] == [(4.0, 2), (5.0, 1)]


def test_unknown_aggregate():
    with pytest.raises(ValueError):
        named_aggregates(["median"])


def brute_rate(rows, seconds):
    out = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, v) for k, t, v in rows if k == key)
        for i, (t, _) in enumerate(mine):
            j = min(x for x in range(i + 1) if mine[x][0] >= t - seconds)
            total = sum((b - a) if b >= a else b for (_, a), (_, b) in zip(mine[j:i], mine[j + 1 : i + 1]))
            out[key, t] = total / seconds
    return out


@pytest.mark.parametrize("segment", [300, 1000, 3600])
def test_rate_equals_brute_force(spark, segment):
    rng = random.Random(segment)
    rows = [(k, t, float(rng.randrange(100))) for k, n in (("hot", 900), ("cold", 30))
            for t in sorted(rng.sample(range(0, 7200), n))]
    rows += [("edge", t, float(t)) for t in (0, 300, 600, 900, 1000, 1300)]  # exactly a range and a segment apart
    df = points(spark, [(t, v, {"s": k}) for k, t, v in rows]).select(
        F.col("labels")["s"].alias("k"), "time_unix_nano", "value")
    got = {(r.k, (r.time_unix_nano - BASE_NANOS) / SECOND): r.rate for r in rate(df, 300, ("k",), segment_seconds=segment).collect()}
    want = brute_rate(rows, 300)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rate_spreads_a_series_over_segments_with_one_shuffle(spark):
    df = points(spark, [(0, 1, {})]).select("time_unix_nano", "value", F.lit("a").alias("k"))
    result = rate(df, 300, ("k",))
    assert exchanges(result) == 1 and "_segment" in plan(result).split("Exchange hashpartitioning(")[1].split(")")[0]
    with pytest.raises(ValueError):
        rate(df, 300, ("k",), segment_seconds=60)


def exact_percentile(values, percent):
    values = sorted(values)
    at = (len(values) - 1) * percent / 100
    low, high = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("percent", [0, 0.01, 37.3, 50, 95, 99.99, 100])
def test_percentile_equals_brute_force(spark, percent):
    rng = random.Random(1)
    groups = {
        "hot": [rng.gauss(0, 100) for _ in range(20_000)],
        "copies": [5.0] * 9000 + [rng.random() for _ in range(3000)],
        "small": [1.0, 2.0, 3.5],
        "one": [7.0],
        None: [1.0, 1.0, 4.0, 9.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("small", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, value double").repartition(8)
    got = {r.g: (r.n, r.percentile) for r in percentile(df, ["g"], percent, accuracy=200).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values)
        assert got[g][1] == pytest.approx(exact_percentile(values, percent), abs=1e-9)


def test_percentile_of_everything(spark):
    df = spark.range(1, 10_002).select(F.col("id").cast("double").alias("value"))
    (row,) = percentile(df, [], 95, accuracy=100).collect()
    assert (row.n, row.percentile) == (10_001, 9501.0)


@pytest.mark.parametrize(
    "value",
    ["id", "7", "id % 3", "-id", "exp(id / 500)", "CASE WHEN id % 2 = 0 THEN 1e300 ELSE -1e300 END + id", "pow(-1, id) * exp(id / 900)"],
)
def test_percentile_narrows_its_bounds(spark, monkeypatch, value):
    monkeypatch.setattr(distribution, "MOST_VALUES", 10)
    monkeypatch.setattr(distribution, "SPLITS", 16)
    df = spark.range(200_000 if "exp" not in value else 100_000).selectExpr(f"CAST({value} AS DOUBLE) AS value", "id % 3 AS g")
    values = df.toPandas()
    (row,) = percentile(df, [], 95, accuracy=100).collect()
    assert row.percentile == pytest.approx(exact_percentile(values["value"].tolist(), 95), rel=1e-12)
    for r in percentile(df, ["g"], 0.1, accuracy=100).collect():
        assert r.percentile == pytest.approx(exact_percentile(values["value"][values["g"] == r.g].tolist(), 0.1), rel=1e-9)


def test_percentile_of_no_rows(spark):
    none = spark.range(0).selectExpr("CAST(id AS DOUBLE) AS value", "id AS g")
    assert percentile(none, ["g"], 95).collect() == []


def test_percentile_estimate(spark):
    df = spark.range(1, 10_002).select(F.col("id").cast("double").alias("value"))
    assert abs(df.agg(percentile_estimate(95)).first()[0] - 9501) <= 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1.99, 2, 9.9, 10)], "value double")
    rows = {r.bin: (r.n, r.bin_from, r.bin_to) for r in histogram(df, 5).collect()}
    assert rows == {0: (3, 0.0, 2.0), 1: (1, 2.0, 4.0), 4: (2, 8.0, 10.0)}
    same = spark.createDataFrame([(3.0,)] * 4, "value double")
    assert [(r.bin, r.n) for r in histogram(same, 5).collect()] == [(0, 4)]
    assert [(r.bin, r.n) for r in histogram(same, 5, least_width=1e-6).collect()] == [(0, 4)]
    assert "Cartesian" not in plan(histogram(df)) and "NestedLoop" not in plan(histogram(df))


def test_first_points_are_cut_before_the_shuffle(spark):
    df = points(spark, [(i, i, {"s": "hot" if i % 3 else str(i)}) for i in range(300)])
    rows = first_per_series(df, 2)
    assert rows.where("series_key like '%hot%'").count() == 2
    text = plan(rows)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in keep_last(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    assert "WindowGroupLimit" in plan(keep_last(df, ["k"], ["t"]))


def test_lookups_over_different_labels(spark):
    df = points(spark, [(i, i, {"__name__": "cpu", "host": f"h{i % 2}"}) for i in range(10)])
    rows = first_of_selectors(df, [{"__name__": "cpu"}, {"host": "h1"}, {"__name__": "x", "host": "h1"}], 3, ["value"])
    got = sorted((r["query"], r.position, r.value) for r in rows.collect())
    assert got == [(0, 1, 0.0), (0, 2, 1.0), (0, 3, 2.0), (1, 1, 1.0), (1, 2, 3.0), (1, 3, 5.0)]
