"""Documents made ready for training: five stages, each of which works on all that the stage before kept.

All stages but the last return the columns they are given. A row is known by its number in the table that a stage is
given, so rows with a null id or with an id that others have are judged like all others: each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm import byte_bpe, decontamination, jaccard_join, quality, toxicity
from pulselake.llm.common import in_fold, table, written

ROW, SCORE = "_row number", "_score of the text"
BROADCAST_ROWS = 2_000_000  # 16 MB of row numbers
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    measured = written(quality.measure(docs, ["doc_id"]), "quality")
    model = quality.train(measured, _labels(spark, sf_dir, "quality").filter(~in_fold(3, 1)))
    return quality.append(docs, model, SCORE).filter(F.col(SCORE) >= 0.5).select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    models = toxicity.train(docs, _labels(spark, sf_dir, "toxic"), ~in_fold(4, 2))
    return toxicity.append(docs, models, SCORE).filter(F.col(SCORE) < toxicity.CUT).select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with their numbers, which are the same at every reading of a written table."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows but those of the written numbers, which go to every executor if they are few enough, so that texts stay in place."""
    few = rows.count() <= BROADCAST_ROWS
    return _numbered(docs).join(F.broadcast(rows) if few else rows, ROW, "left_anti").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 of their five-word sets, the one with the smallest id, then the first."""
    rows = _numbered(docs)
    groups = jaccard_join.join_components(rows.select(F.col(ROW).alias("doc_id"), "text"), size=5, percent=80)
    members = groups.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("best")
    stays = members.groupBy("component_id").agg(best).select(F.col("best")[ROW].alias(ROW))
    return _without(docs, written(rows.select(ROW).join(written(stays, "stays"), ROW, "left_anti"), "others"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    texts = _numbered(docs).select(F.col(ROW).alias("doc_id"), "text")
    hits = decontamination.match(texts, table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0)
    return _without(docs, written(hits.select(F.col("doc_id").alias(ROW)).distinct(), "contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the text decoded from them."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", uncontaminated),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
