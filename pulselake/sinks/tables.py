"""Writing telemetry tables: layout, appends, retention."""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.times import duration_seconds, in_range, instant
from pulselake.schemas import TABLES

UNKNOWN = "unknown"

# How long each signal is kept where nothing else is said.
KEEP = {"metrics": "30d", "logs": "7d", "traces": "7d"}

# Columns rows are sorted by within a file, and columns with a bloom filter.
SORT = {
    "metrics": ["name", "series_key", "time_unix_nano"],
    "logs": ["time_unix_nano"],
    "traces": ["trace_id", "time_unix_nano"],
}
BLOOM = {"metrics": ["name", "service"], "logs": ["level", "service"], "traces": ["trace_id", "service"]}


def contract(df: DataFrame, signal: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table columns in order and type; a missing or empty metric name becomes ``unknown``."""
    if signal == "metrics":
        df = df.withColumn("name", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(UNKNOWN)))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[signal].fields], *keep)


def laid_out(df: DataFrame, signal: str, partitions: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Rows gathered by day and sorted for row-group pruning.

    ``rebalance`` lets adaptive execution split a day with most of the rows into several files and join
    small ones; one task never has to write a whole day.
    """
    return df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *SORT[signal])


def writer(df: DataFrame, signal: str, partitions: tuple[str, ...] = ("dt",)):
    out = laid_out(df, signal, partitions).write.partitionBy(*partitions)
    for column in BLOOM[signal]:
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return out


def append(df: DataFrame, path: str, signal: str) -> None:
    """Adds rows to a table folder partitioned by day."""
    writer(contract(df, signal), signal).mode("append").parquet(path)


def save_as_table(df: DataFrame, table: str, signal: str) -> None:
    """As ``append`` into a catalog table, where ``retain`` can drop days."""
    writer(contract(df, signal), signal).mode("append").format("parquet").saveAsTable(table)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def cutoff(signal: str, now: datetime | str, keep: str | None = None) -> datetime:
    """The oldest instant kept."""
    return instant(now) - timedelta(seconds=duration_seconds(keep or KEEP[signal]))


def unexpired(df: DataFrame, signal: str, now: datetime | str, keep: str | None = None) -> DataFrame:
    """Rows not older than the retention of their signal."""
    return in_range(df, cutoff(signal, now, keep), None)


def _partitions(spark: SparkSession, table: str) -> DataFrame:
    """The partitions of a catalog table: their day and all their values by column."""
    parts = F.split("partition", "/")
    value = lambda p: F.struct(F.substring_index(p, "=", 1).alias("column"), F.substring_index(p, "=", -1).alias("value"))
    return spark.sql(f"SHOW PARTITIONS {table}").select(
        F.substring_index(F.get(parts, 0), "=", -1).alias("day"), F.transform(parts, value).alias("spec")
    )


def _drop(spark: SparkSession, table: str, partitions: DataFrame, at_once: int = 100) -> None:
    rows = partitions.collect()  # metadata: one row a partition folder
    for i in range(0, len(rows), at_once):
        specs = ["PARTITION (" + ", ".join(f"{c} = '{v}'" for c, v in r.spec) + ")" for r in rows[i : i + at_once]]
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(specs)}")


def retain(spark: SparkSession, table: str, signal: str, now: datetime | str, keep: str | None = None) -> None:
    """Drops the days of a catalog table before the cutoff and rewrites the day the cutoff falls in.

    Whole days go without reading a row. Of the cutoff's day only the rows kept are read, and written with
    dynamic partition overwrite, which replaces what it writes when the job commits; a lost executor or a
    second run does no harm. Partitions of that day without a row left are dropped.
    """
    limit = cutoff(signal, now, keep)
    day = limit.date().isoformat()
    partitions = _partitions(spark, table)
    _drop(spark, table, partitions.where(F.col("day") < day))
    of_day = partitions.where(F.col("day") == day)
    first = of_day.first()
    if first is None or (limit.hour, limit.minute, limit.second, limit.microsecond) == (0, 0, 0, 0):
        return
    columns = tuple(c for c, _ in first.spec)
    kept = unexpired(spark.table(table).where(F.col("dt") == F.lit(limit.date())), signal, now, keep)
    left = [F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns]).alias("left")]
    found = kept.select(*left).distinct()
    folder = F.array_join(F.transform("spec", lambda s: F.concat(s["column"], F.lit("="), s["value"])), "/")
    empty = of_day.join(found, folder == F.col("left"), "left_anti")
    _drop(spark, table, empty)
    location = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
    (
        writer(contract(kept, signal, columns[1:]), signal, columns)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(location)
    )
    spark.catalog.refreshTable(table)


def retain_folder(spark: SparkSession, path: str, signal: str, now: datetime | str, keep: str | None = None) -> None:
    """As ``retain`` for a table folder that no catalog knows, such as ingest writes.

    Folders of days before the cutoff are deleted unread. Of the cutoff's day each partition folder is judged by its own
    rows: one without a row to keep is deleted, one of which all rows stay is left as it is, and only the others are
    rewritten. It may be repeated after a failure. A folder of a stream's file sink is refused, as the sink's log names its
    files.
    """
    limit = cutoff(signal, now, keep)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(Path(root, "_spark_metadata")):
        raise ValueError(f"{path} is kept by a stream's file sink")
    day = limit.date().isoformat()
    for found in files.globStatus(Path(root, "dt=*")):
        if found.getPath().getName().removeprefix("dt=") < day:
            files.delete(found.getPath(), True)
    if not files.exists(Path(root, f"dt={day}")) or (limit.hour, limit.minute, limit.second, limit.microsecond) == (0, 0, 0, 0):
        return
    names = [f.name for f in TABLES[signal].fields]
    table = spark.read.schema(TABLES[signal]).parquet(path).where(F.col("dt") == F.lit(limit.date()))
    columns = ("dt", *[c for c in table.columns if c not in names])
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = table.select("*", folder.alias("_folder"))
    left = F.count_if(F.col("ts") >= F.lit(limit))
    counts = rows.groupBy("_folder").agg(F.count(F.lit(1)).alias("n"), left.alias("left"))
    judged = {r["_folder"]: r for r in counts.collect()}  # a row for each partition folder of the day
    mixed = [f for f, r in judged.items() if 0 < r.left < r.n]
    if mixed:
        chosen = spark.createDataFrame([(f,) for f in mixed], "_folder string")
        kept = unexpired(rows.join(F.broadcast(chosen), "_folder", "left_semi"), signal, now, keep)
        out = writer(contract(kept, signal, columns[1:]), signal, columns).mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").parquet(path)
    for f, r in judged.items():
        if not r.left:
            files.delete(Path(unquote(f)), True)
