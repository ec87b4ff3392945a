import glob

import pytest
from helpers import BASE, iso, points
from pyspark.sql import functions as F

from pulselake.operators.series import with_series_key
from pulselake.schemas import POINTS
from pulselake.session import CHECKPOINT_DIR, shared_folder
from pulselake.sinks.tables import append, contract, cutoff, retain, retain_folder, save_as_table, unexpired, write_json
from pulselake.sources.tables import read_table, scan


def days(spark, n=10, per_day=4):
    rows = [(86400 * d + 86400 / per_day * i, d, {"__name__": "cpu", "host": str(i)}) for d in range(n) for i in range(per_day)]
    return with_series_key(points(spark, rows)).withColumn("dt", F.col("ts").cast("date"))


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "points")
    append(days(spark, 3), path, "metrics")
    append(days(spark, 1), path, "metrics")
    back = read_table(spark, path, "metrics")
    assert back.schema.names == [f.name for f in POINTS.fields]
    assert back.count() == 16 and len(glob.glob(f"{path}/dt=*")) == 3
    assert scan(read_table(spark, path, "metrics", iso(0), iso(100)), iso(0), iso(100)).count() == 2
    assert read_table(spark, path, "metrics", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z").count() == 0
    assert read_table(spark, path, "metrics", "2020-01-01T00:00:00Z", "2023-01-01T00:00:00Z").count() == 0
    assert scan(read_table(spark, path, "metrics", "2020-01-01T00:00:00Z", iso(0)), None, iso(0)).count() == 2


def test_rows_of_a_file_are_sorted(spark, tmp_path):
    path = str(tmp_path / "points")
    append(days(spark, 1, 50).orderBy(F.rand(1)), path, "metrics")
    (file,) = glob.glob(f"{path}/dt=*/*.parquet")
    keys = [r.series_key for r in spark.read.parquet(file).collect()]
    assert keys == sorted(keys)


def test_missing_name(spark):
    df = days(spark, 1).withColumn("name", F.when(F.col("labels")["host"] == "1", "").when(F.col("labels")["host"] == "2", F.lit(None)).otherwise("cpu"))
    assert sorted(r.name for r in contract(df, "metrics").collect()) == ["cpu", "cpu", "unknown", "unknown"]


def test_default_retention():
    now = "2024-02-10T00:00:00Z"
    assert (cutoff("metrics", now) - BASE).days == 10 and (cutoff("logs", now) - BASE).days == 33


def test_unexpired(spark):
    assert unexpired(days(spark), "metrics", "2024-01-10T12:00:00Z", "2d").count() == 10


def test_retain_drops_days_and_rewrites_one(spark):
    table = "kept_points"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    save_as_table(days(spark), table, "metrics")
    assert spark.table(table).count() == 40
    retain(spark, table, "metrics", "2024-01-10T12:00:00Z", "2d")
    left = spark.table(table)
    assert left.agg(F.min("ts").cast("string")).first()[0] == "2024-01-08 12:00:00"
    assert left.count() == 10
    assert [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()] == [f"dt=2024-01-{d:02d}" for d in (8, 9, 10)]
    retain(spark, table, "metrics", "2024-01-10T12:00:00Z", "2d")  # a second run changes nothing
    assert spark.table(table).count() == 10
    retain(spark, table, "metrics", "2024-01-12T00:00:00Z", "2d")  # a cutoff at midnight rewrites nothing
    assert spark.table(table).count() == 4
    retain(spark, table, "metrics", "2024-01-12T23:00:00Z", "2d")  # nothing of the cutoff's day is left
    assert spark.table(table).count() == 0
    spark.sql(f"DROP TABLE {table}")


def test_retain_keeps_further_partition_columns(spark):
    table = "kept_batches"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df = days(spark, 3).withColumn("ingest_batch", F.col("labels")["host"].cast("int") % 2)
    df.write.partitionBy("dt", "ingest_batch").format("parquet").saveAsTable(table)
    retain(spark, table, "metrics", "2024-01-03T07:00:00Z", "1d")
    assert sorted((str(r.dt), r.ingest_batch, r.n) for r in spark.table(table).groupBy("dt", "ingest_batch").agg(
        F.count("*").alias("n")).collect()) == [
        ("2024-01-02", 0, 1), ("2024-01-02", 1, 1), ("2024-01-03", 0, 2), ("2024-01-03", 1, 2)]
    spark.sql(f"DROP TABLE {table}")


def test_retain_folder(spark, tmp_path):
    path = str(tmp_path / "a table")
    append(days(spark), path, "metrics")
    rows = lambda: read_table(spark, path, "metrics")
    every = rows().count()
    for now, keep, least, n in [
        ("2024-01-10T12:00:00Z", "2d", "2024-01-08 12:00:00", 10), ("2024-01-10T12:00:00Z", "2d", "2024-01-08 12:00:00", 10),
        ("2024-01-11T00:00:00Z", "2d", "2024-01-09 00:00:00", 8), ("2024-01-11T23:00:00Z", "2d", "2024-01-10 00:00:00", 4),
    ]:
        retain_folder(spark, path, "metrics", now, keep)
        assert (rows().count(), rows().agg(F.min("ts").cast("string")).first()[0]) == (n, least)
    assert every == 40 and sorted(f.rsplit("/", 1)[1] for f in glob.glob(path + "/dt=*")) == ["dt=2024-01-10"]


def test_retain_folder_judges_each_batch(spark, tmp_path):
    """Batches of the cutoff's day: one expired, one kept as it is, one rewritten; a second signal's default keep."""
    path = str(tmp_path / "ingested")
    hour = F.hour("ts")
    batch = F.when(hour < 6, "early-1").when(hour >= 18, "late-2").otherwise("mid-3")
    df = contract(days(spark, 3, 24), "metrics").withColumn("ingest_batch", batch)
    df.write.partitionBy("dt", "ingest_batch").parquet(path)
    kept_as_is = glob.glob(path + "/dt=2024-01-02/ingest_batch=late-2/*.parquet")
    retain_folder(spark, path, "metrics", "2024-01-04T09:00:00Z", "2d")
    got = {(str(r.dt), r.ingest_batch): r.n for r in spark.read.parquet(path).groupBy("dt", "ingest_batch").agg(F.count("*").alias("n")).collect()}
    assert got == {("2024-01-02", "mid-3"): 9, ("2024-01-02", "late-2"): 6, ("2024-01-03", "early-1"): 6, ("2024-01-03", "mid-3"): 12, ("2024-01-03", "late-2"): 6}
    assert glob.glob(path + "/dt=2024-01-02/ingest_batch=late-2/*.parquet") == kept_as_is
    assert not glob.glob(path + "/dt=2024-01-02/ingest_batch=early-1")


def test_retain_folder_refuses_a_sink_with_a_log(spark, tmp_path):
    (tmp_path / "_spark_metadata").mkdir()
    with pytest.raises(ValueError, match="file sink"):
        retain_folder(spark, str(tmp_path), "metrics", "2024-01-04T09:00:00Z")


def test_json_sink(spark, tmp_path):
    write_json(days(spark, 1).select("name", "labels"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).where("value like '%\"labels\":{%'").count() == 4


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get(CHECKPOINT_DIR))
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_shared_folder_where_none_is_set():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

    first, second = shared_folder(Session, "x"), shared_folder(Session, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_a_cluster_must_name_its_shared_folder():
    class Conf(dict):
        pass

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="spark://host:7077"), "x")
    assert shared_folder(Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert shared_folder(Session(spark_master="local[2]"), "x")
