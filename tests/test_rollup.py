"""Roll-ups against the points themselves."""

import random

import pytest
from helpers import iso, plan, points
from pyspark.sql import functions as F

from pulselake.functions.times import instant
from pulselake.operators import rollup
from pulselake.operators.series import downsample, with_series_key

HOUR, DAY = 3600, 86_400


@pytest.fixture(scope="module")
def rolled_up(spark, tmp_path_factory):
    """Three days of two series, the second day's points of one of them come late, and a batch is repeated."""
    rng = random.Random(2)
    rows = [(t + rng.random() / 2, rng.randrange(10**6), {"__name__": n}) for n, gap in (("a", 97), ("b", 1201)) for t in range(0, 3 * DAY, gap)]
    df = points(spark, rows).unionByName(points(spark, [(50, 0, {"__name__": "c"})]).withColumn("value", F.lit(None).cast("double")))
    df = with_series_key(df).cache()
    late = (F.col("name") == "a") & (F.dayofmonth("ts") == 2)
    path = str(tmp_path_factory.mktemp("rollups"))
    rollup.write_rollups(df.where(~late), path, "first")
    rollup.write_rollups(df.where(late), path, "late")
    rollup.write_rollups(df.where(late), path, "late")
    return df, path


@pytest.mark.parametrize("step", [60, 300, HOUR, 2 * HOUR, DAY, 3 * DAY])
@pytest.mark.parametrize(("start", "end"), [(0, 3 * DAY), (DAY, 2 * DAY), (2 * HOUR, DAY + 4 * HOUR)])
def test_exact_aggregates(spark, rolled_up, step, start, end):
    df, path = rolled_up
    got = rollup.rolled(spark, path, step, iso(start), iso(end))
    inside = df.where((F.col("ts") >= F.lit(instant(iso(start)))) & (F.col("ts") < F.lit(instant(iso(end)))) & F.col("value").isNotNull())
    stats = [F.count("value").alias("count"), F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min("value").alias("min"),
             F.max("value").alias("max"), F.max_by("value", "time_unix_nano").alias("latest")]
    want = downsample(inside, step, stats)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_percentiles_are_near_their_rank(spark, rolled_up):
    df, path = rolled_up
    for r in rollup.rolled(spark, path, DAY, iso(0), iso(3 * DAY), (50, 95, 99.5)).collect():
        values = [v.value for v in df.where((F.col("series_key") == r.series_key) & (F.col("ts").cast("date") == F.lit(r.bucket.date()))).collect()]
        for percent in (50, 95, 99.5):
            found = r[f"p{percent:g}"]
            low, high = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
            assert low - 0.02 <= percent / 100 <= high + 0.02


def test_the_coarsest_table_is_read(spark, rolled_up):
    at = lambda step, start=0, end=3 * DAY: rollup.table_step(step, instant(iso(start)), instant(iso(end)))
    assert (at(DAY), at(2 * DAY), at(2 * HOUR), at(90 * 60), at(DAY, HOUR), at(DAY, 60)) == (DAY, DAY, HOUR, 60, HOUR, 60)
    for step, start in ((30, 0), (DAY, 30)):
        with pytest.raises(ValueError, match="no roll-up"):
            at(step, start)
    text = plan(rollup.rolled(spark, rolled_up[1], 2 * HOUR, iso(DAY), iso(2 * DAY)))
    assert "step_3600" in text and "PartitionFilters: [isnotnull(dt" in text and text.count("Exchange ") == 1


def test_steps_must_nest(spark, tmp_path):
    with pytest.raises(ValueError, match="must divide"):
        rollup.write_rollups(points(spark, [(0, 1, {"__name__": "a"})]), str(tmp_path), "x", (60, 90))


def test_no_points(spark, tmp_path):
    rollup.write_rollups(points(spark, [(0, 1, {"__name__": "a"})]).limit(0), str(tmp_path), "x")
    rollup.write_rollups(points(spark, [(0, 1, {"__name__": "a"})]), str(tmp_path), "y")
    assert rollup.rolled(spark, str(tmp_path), DAY, iso(DAY), iso(2 * DAY)).count() == 0
    assert [r["count"] for r in rollup.rolled(spark, str(tmp_path), DAY, iso(0), iso(DAY), (50,)).collect()] == [1]
