"""Exact duplicates: a tree-merge of sorted digest runs, in DataFrame operations only.

A text without its white space is known by its SHA-256, verified at every level by its length in bytes and by a second digest.
Each partition of the input is a run: its digests, sorted and reduced to one row each, which names the row that stays so
far. In every round ``FAN`` neighbouring runs are exchanged and merged into one by a sorted aggregation, which keeps
the best row and the sum of the sizes, until one run is left. The answers then go back down the same tree: a row
of a run meets its digest's answer in the merged run, so no join key has more than ``FAN`` rows on the way down, nor
more than one run has rows at the end. A group may hold any share of the table.

Defined cases: null text is empty, and all empty texts (white space only, too) are one group. Of equal texts the row
with the most code points stays, then the smallest id; a null id comes after all others; of rows that share even the id
the first as read stays, so exactly one row of a group is kept. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import table, written

FAN = 16
WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check", "n_bytes"]


def digest_rows(docs: DataFrame) -> DataFrame:
    """(run, row, doc_id, n_chars, digest, check, n_bytes) of every row, as a written table."""
    text = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", F.length(text).alias("n_chars"), F.regexp_replace(text, WHITE_SPACE, "").alias("bare"))
    return written(
        bare.select(
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_chars",
            F.unhex(F.sha2("bare", 256)).alias("digest"),
            F.xxhash64("bare").alias("check"),
            F.octet_length("bare").alias("n_bytes"),
        ),
        "digest-rows",
    )


def merge_up(rows: DataFrame) -> list[DataFrame]:
    """The runs of every level, (run, key, best, n), from one a partition to a single one."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [written(rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n")), "runs")]
    while runs > 1:
        runs = -(-runs // FAN)
        moved = levels[-1].withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
        levels.append(written(moved.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")), "runs"))
    return levels


def answer_down(levels: list[DataFrame]) -> DataFrame:
    """(run, key, best, n) of the lowest level's runs with the answers of the last one."""
    answers = levels[-1]
    for level in reversed(levels[:-1]):
        above = answers.withColumnRenamed("run", "above")
        own = level.select("run", *KEY, F.floor(F.col("run") / FAN).cast("int").alias("above"))
        answers = own.join(above, ["above", *KEY]).select("run", *KEY, "best", "n")
    return answers


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text)."""
    rows = digest_rows(docs.select("doc_id", "text"))
    answers = answer_down(merge_up(rows))
    return rows.select("run", "row", "doc_id", *KEY).join(answers, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
