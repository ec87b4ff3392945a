"""An index of trigrams by file: a text search reads only files that can hold the text.

A signature of a file is a bitmap, in ``BUCKETS`` parts of 4 KB, with a bit for the hash of each run of three characters that a
message or label value in it has, case ignored. A text of three characters or more can only be in files whose
bitmap has the bits of all its trigrams; these are read and searched as without the index, so results are the same. Files are
never rewritten under their name: a file the index does not know is read, and indexed by the next ``index_texts``.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.times import instant
from pulselake.operators.logs import search
from pulselake.schemas import TABLES
from pulselake.sources.tables import read_table

BUCKETS, BUCKET_BITS = 8, 32_768
SIGNATURES = "file string, bucket int, bits binary"


def trigrams(text: Column) -> Column:
    """Runs of three characters, in lower case; no array for null, an empty one for shorter texts."""
    join = lambda a, b: F.concat(a, b)
    one = F.split(F.lower(text), "")
    two = F.zip_with(one, F.slice(one, 2, F.size(one)), join)
    return F.array_distinct(F.array_compact(F.zip_with(two, F.slice(one, 3, F.size(one)), join)))


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS * BUCKET_BITS)).cast("int")


def _place(bit: Column) -> list[Column]:
    return [F.floor(bit / BUCKET_BITS).cast("int").alias("bucket"), (bit % BUCKET_BITS).cast("int").alias("position")]


def file_bits(rows: DataFrame) -> DataFrame:
    """(file, bit) of the trigrams of log rows that come straight from a scan; a task gives each bit of a file once.

    The bitmaps are built from sorted rows, so what a task sorts must not grow with its rows. Tasks read one file after the
    other and remember the bits of the last one.
    """
    texts = F.concat(F.array("message"), F.coalesce(F.map_values("labels"), F.array().cast("array<string>")))
    each = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(texts).alias("text"))
    listed = each.select("file", F.transform(trigrams(F.col("text")), _bit).alias("bits"))

    def firsts(batches):
        last, seen = None, np.zeros(0, bool)
        for batch in batches:
            bits, names = batch.column(1), batch.column(0).dictionary_encode()
            owner = names.indices.to_numpy()[pc.list_parent_indices(bits).to_numpy()]
            bits = pc.list_flatten(bits).to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                if name != last:
                    last, seen = name, np.zeros(BUCKETS * BUCKET_BITS, bool)
                own = np.unique(bits[owner == i])
                new = own[~seen[own]]
                seen[new] = True
                yield pa.record_batch([pa.array([name] * len(new), pa.string()), pa.array(new, pa.int32())], names=["file", "bit"])

    return listed.mapInArrow(firsts, "file string, bit int")


def signatures(rows: DataFrame) -> DataFrame:
    """(file, bucket, bits) of log rows that come straight from a scan; bitmaps are combined before the shuffle."""
    grams = file_bits(rows).select("file", *_place(F.col("bit")))
    return grams.groupBy("file", "bucket").agg(F.bitmap_construct_agg(F.col("position").cast("bigint")).alias("bits"))


def _plain(file: str) -> str:
    return re.sub(r"^file:/*", "/", file)


def _files(spark: SparkSession, path: str, start=None, end=None) -> dict[str, str]:
    """The table's files of these days by plain name. Only folders are listed, and never taken from a cached table."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    day = F.col("dt").cast("date")
    if start is not None:
        listed = listed.where(day >= F.lit(instant(start).date()))
    if end is not None:
        listed = listed.where(day <= F.lit(instant(end).date()))
    return {_plain(r.path): r.path for r in listed.select("path").collect()}


def read_signatures(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema(SIGNATURES).parquet(index_path)


def _known(marks: DataFrame) -> set[str]:
    return {_plain(unquote(r.file)) for r in marks.select("file").distinct().collect()}


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    reader = spark.read.schema(TABLES["logs"]).option("basePath", path)
    return reader.parquet(*files) if files else read_table(spark, path, "logs").where(F.lit(False))


def index_texts(spark: SparkSession, path: str, index_path: str) -> int:
    """Add the files of a log table that the index does not know yet; how many there were. May be repeated after a failure."""
    spark.createDataFrame([], SIGNATURES).write.mode("ignore").parquet(index_path)
    known = _known(read_signatures(spark, index_path))
    new = [f for name, f in sorted(_files(spark, path).items()) if name not in known]
    if new:
        signatures(_read(spark, path, new)).write.mode("append").parquet(index_path)
    return len(new)


def files_with(marks: DataFrame, text: str) -> DataFrame:
    """(file): files whose signature has all trigrams of the text; all files if the text has none."""
    spark = marks.sparkSession
    grams = spark.range(1).select(F.explode(trigrams(F.lit(text.lower()))).alias("gram")).select(*_place(_bit(F.col("gram")))).distinct()
    wanted = grams.collect()  # as many as the text has characters
    if not wanted:
        return marks.select("file").distinct()
    bits = spark.createDataFrame([tuple(r) for r in wanted], "bucket int, position int")
    byte = F.conv(F.hex(F.expr("substring(bits, position div 8 + 1, 1)")), 16, 10).cast("int")
    has = byte.bitwiseAND(F.expr("shiftleft(1, position % 8)")) != 0
    found = marks.join(bits, "bucket").where(has).select("file", "bucket", "position").distinct()
    return found.groupBy("file").count().where(F.col("count") == len(wanted)).select("file")


def candidate_files(spark: SparkSession, path: str, index_path: str, text: str, start=None, end=None) -> tuple[list[str], int]:
    """The files of a range of days that may hold the text, and how many files the range has."""
    marks = read_signatures(spark, index_path)
    every = _files(spark, path, start, end)
    left_out = _known(marks) - _known(files_with(marks, text))
    return [f for name, f in sorted(every.items()) if name not in left_out], len(every)


def search_indexed(spark: SparkSession, path: str, index_path: str, text: str | None, start=None, end=None) -> DataFrame:
    """As ``search`` on the table's days from start to end, from the files that may hold the text."""
    if not text:
        return search(read_table(spark, path, "logs", start, end), text)
    files, _ = candidate_files(spark, path, index_path, text, start, end)
    return search(_read(spark, path, files), text)
