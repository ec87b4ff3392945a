"""What the operators of this subpackage share: reading, slicing of batches, written tables, folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.session import shared_folder


BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python tasks of the session get Arrow batches of ``BATCH_BYTES`` or one row, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: lineage ends there and nothing is computed twice."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def in_fold(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(modulus, doc_id) == remainder, F.lit(False))


def slices(sizes: Sequence[int], size_limit: int, row_limit: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to the limit at most; a larger row comes alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > size_limit or i - start >= row_limit):
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def code_points(texts: Sequence[str]) -> np.ndarray:
    """The code points of all texts in one array; lone surrogates are kept."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def append_scores(docs: DataFrame, name: str, kept: "Kept", text_col: str = "text") -> DataFrame:
    """All columns of docs and a double ``name``: what the kept model's ``text_scores`` gives for the texts of a batch."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(kept.get().text_scores(texts), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


_slot: dict = {}


def held(key, make):
    """What a worker process keeps from one batch or task to the next: one value, freed when another is asked for.

    Workers are used again by later stages, so whatever they keep adds up over a pipeline unless it shares a slot.
    """
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


class Kept:
    """A broadcast value with what a worker process derives from it once."""

    def __init__(self, spark: SparkSession, value, derive):
        self.value, self.derive = spark.sparkContext.broadcast(value), derive

    def get(self):
        key = self.value._path if hasattr(self.value, "_path") else id(self.value)
        return held(key, lambda: self.derive(self.value.value))
