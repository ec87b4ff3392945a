"""Text search by the trigram index: nothing lost, files left out."""

import random
import string

import pytest
from pyspark.sql import functions as F

from pulselake.operators import text_index as ti
from pulselake.operators.logs import search
from pulselake.sinks.tables import append
from pulselake.sources.tables import read_table
from helpers import iso, logs

DAY = 86_400


def _rows(df):
    return sorted((r.time_unix_nano, r.message or "") for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Eight days, a file or more each; words of a day are rare in the others."""
    rng = random.Random(4)
    rows = []
    for day in range(8):
        own = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(12)]
        for i in range(60):
            message = " ".join(rng.choice(own + ["Request", "failed", "ÄÖÜß", "日本語だ", "a😀b"]) for _ in range(6))
            rows.append((day * DAY + i, "INFO", message, {"service.name": f"Shop-{day}-{i % 3}", "empty": ""}))
    rows += [(5, "INFO", None, None), (6, "INFO", "", {}), (7, "INFO", "ab", {"x": None})]
    path = str(tmp_path_factory.mktemp("logs") / "table x")
    df = logs(spark, rows).withColumns({"severity_number": F.lit(9), "service": F.col("labels")["service.name"], "dt": F.col("ts").cast("date")})
    append(df, path, "logs")
    assert ti.index_texts(spark, path, path + "-index") >= 8
    return path, rows


def test_nothing_is_lost(spark, table):
    path, rows = table
    rng = random.Random(1)
    every = read_table(spark, path, "logs").cache()
    wanted = ["SHOP-3", "日本語", "öü", "a😀B", "ßno", "shop-1-2shop", "ab", "x" * 300, "", "\u0001x"]
    for _ in range(12):
        message = rng.choice(rows[:480])[2]
        a = rng.randrange(len(message))
        wanted.append(message[a : a + rng.randint(1, 15)].swapcase() if rng.random() < 0.5 else message[a : a + 9])
    for text in wanted:
        assert _rows(ti.search_indexed(spark, path, path + "-index", text)) == _rows(search(every, text)), text
    every.unpersist()


def test_files_are_left_out(spark, table):
    path, rows = table
    files, total = ti.candidate_files(spark, path, path + "-index", "Shop-3-1")
    assert total >= 8 and 1 <= len(files) <= total // 4
    assert ti.candidate_files(spark, path, path + "-index", "no such text")[0] == []
    assert ti.search_indexed(spark, path, path + "-index", "no such text").count() == 0
    assert len(ti.candidate_files(spark, path, path + "-index", "ab")[0]) == total  # no trigram, so all files
    files, of_days = ti.candidate_files(spark, path, path + "-index", "request", iso(DAY), iso(2 * DAY))
    assert of_days < total and len(files) == of_days


def test_new_files_are_read_and_then_indexed(spark, tmp_path):
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    dated = lambda rows: logs(spark, rows).withColumns({"severity_number": F.lit(9), "service": F.lit("s"), "dt": F.col("ts").cast("date")})
    append(dated([(1, "INFO", "first needle", {}), (2, "INFO", "hay", {})]), path, "logs")
    first = ti.index_texts(spark, path, index)
    append(dated([(3, "INFO", "second NEEDLE", {}), (DAY, "INFO", "straw", {})]), path, "logs")
    assert [m for _, m in _rows(ti.search_indexed(spark, path, index, "needle"))] == ["first needle", "second NEEDLE"]
    before = len(ti.candidate_files(spark, path, index, "needle")[0])
    assert first >= 1 and ti.index_texts(spark, path, index) >= 2 and ti.index_texts(spark, path, index) == 0
    assert len(ti.candidate_files(spark, path, index, "needle")[0]) < before
    assert [m for _, m in _rows(ti.search_indexed(spark, path, index, "needle"))] == ["first needle", "second NEEDLE"]


def test_trigrams(spark):
    texts = ["", "ab", "ABC", "abcab", "a😀bc", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ti.trigrams(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [[], [], ["abc"], ["abc", "bca", "cab"], ["a😀b", "😀bc"], None]


def test_the_scan_reads_few_columns_and_combines_before_the_shuffle(spark, table):
    plan = ti.signatures(read_table(spark, table[0], "logs"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<message:string,labels:map<string,string>>" in plan
    assert plan.count("Exchange ") == 1 and "partial_bitmap_construct_agg" in plan


def test_a_task_gives_each_bit_of_a_file_once(spark, tmp_path):
    messages = ["Request one failed", "request two failed", None, "ab", ""] * 400
    df = logs(spark, [(i, "INFO", m, {"a": "user-7", "b": None}) for i, m in enumerate(messages)]).coalesce(1)
    df.select("message", "labels").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = [r.bit for r in ti.file_bits(spark.read.parquet(str(tmp_path / "t"))).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grams = {t[i : i + 3] for t in ("request one failed", "request two failed", "user-7") for i in range(len(t) - 2)}
    assert len(found) == len(set(found)) == len(grams)
