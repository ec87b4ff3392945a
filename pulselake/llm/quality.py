"""Quality of a text by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics: logarithms of lengths and counts, square roots of shares. Each
class has a mean and a covariance, drawn towards the pooled covariance and then towards its diagonal. The score is the
logistic of the difference of the two Gaussian log densities, Mahalanobis distances by Cholesky factors held in each
worker, and of the log prior.

Means and covariances are exact sums over all labelled rows, added up by Spark; labels meet statistics, not texts, and
every text is read once. Null text counts as empty; an empty text is scored like any other. Labels that are null or of
an id without document are ignored; of an id with several labels each counts. Without both classes every score is the
share of label 1, or 0.5 without labels. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.llm.common import Kept, append_scores, in_fold, slices, table, written

SLICE_CHARS = 2_000_000
SHARES = ["upper", "digit", "space", "line_end", "sentence", "comma", "mark", "bar", "sign", "wide"]
NAMES = ["chars", "words", "word_size", "distinct", "repeat", "lines", "line_repeat", *SHARES]


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, len(SHARES), np.uint8)
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~<>{}[]=+_\\/"]
    for i, group in enumerate(groups):
        kinds[list(group)] = i
    kinds[128:] = SHARES.index("wide")
    return kinds


KINDS = _byte_kinds()


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text, over the whole of it."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in slices([len(t) for t in texts], SLICE_CHARS):
        raw = [t.encode("utf-8", "replace") for t in texts[a:b]]
        sizes = np.array([len(r) for r in raw], np.int64)
        kind = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
        width = len(SHARES) + 1
        owner = np.repeat(np.arange(b - a, dtype=np.int32) * width, sizes)
        counts = np.bincount(owner + kind, minlength=(b - a) * width).reshape(b - a, width)[:, :-1]
        rows = []
        for text in texts[a:b]:
            words, lines = text.split(), text.split("\n")
            n = len(words)
            rows.append((len(text), n, len(set(words)), sum(map(eq, words, words[1:])), len(lines), len(lines) - len(set(lines))))
        chars, n, distinct, repeats, lines, line_repeats = np.array(rows, np.float64).T
        part = out[a:b]
        part[:, 0], part[:, 1] = np.log1p(chars), np.log1p(n)
        part[:, 2] = np.log1p(chars / np.maximum(n, 1))
        part[:, 3] = np.log1p(distinct) - np.log1p(n)
        part[:, 4] = np.sqrt(repeats / np.maximum(n, 1))
        part[:, 5] = np.log1p(lines)
        part[:, 6] = np.sqrt(line_repeats / lines)
        part[:, 7:] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    return out


@dataclass(frozen=True)
class Gaussians:
    """Of class 0 and class 1: log prior, mean and covariance; or a constant score."""

    priors: tuple[float, float]
    means: np.ndarray
    covariances: np.ndarray
    constant: float | None = None


class Scorer:
    """A model with its Cholesky factors."""

    def __init__(self, model: Gaussians):
        self.model = model
        if model.constant is None:
            factors = [np.linalg.cholesky(c) for c in model.covariances]
            self.inverses = [np.linalg.inv(f) for f in factors]
            self.logs = [np.log(np.diag(f)).sum() for f in factors]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(rows), self.model.constant)
        density = [
            prior - log - 0.5 * (((rows - mean) @ inverse.T) ** 2).sum(axis=1)
            for prior, log, mean, inverse in zip(self.model.priors, self.logs, self.model.means, self.inverses)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))

    def text_scores(self, texts: list[str]) -> np.ndarray:
        return self.scores(statistics(texts))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float, to_diagonal: float) -> Gaussians:
    """From the count, sum and sum of outer products of each class."""
    total = counts.sum()
    if not counts.all():
        share = float(counts[1] / total) if total else 0.5
        return Gaussians((0.0, 0.0), sums, products, share)
    means = sums / counts[:, None]
    own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * counts[:, None, None]).sum(axis=0) / total
    mixed = (1 - to_pooled) * own + to_pooled * pooled
    diagonal = np.stack([np.diag(np.diag(c)) for c in mixed])
    floor = 1e-4 * np.eye(mixed.shape[1])
    return Gaussians(
        (float(np.log(counts[0] / total)), float(np.log(counts[1] / total))),
        means,
        (1 - to_diagonal) * mixed + to_diagonal * diagonal + floor,
    )


def measure(docs: DataFrame, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``stats``, an array of the statistics of the whole text."""
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = chosen.drop("_text").schema

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = statistics(texts)
            offsets = pa.array(np.arange(len(texts) + 1) * len(NAMES), pa.int32())
            stats = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))
            yield pa.record_batch([*batch.columns[:-1], stats], names=[*batch.schema.names[:-1], "stats"])

    return chosen.mapInArrow(run, schema.add("stats", T.ArrayType(T.DoubleType())))


def train(measured: DataFrame, labels: DataFrame, to_pooled: float = 0.05, to_diagonal: float = 0.05) -> Gaussians:
    """From measured rows (doc_id, stats) and labels (doc_id, label): exact sums over all rows that have a label."""
    size = len(NAMES)
    known = labels.filter(F.col("label").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    joined = measured.select("doc_id", "stats").join(known, F.col("doc_id") == F.col("_id")).select("label", "stats")

    def moments(batches):
        counts, total, products = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for k in (0, 1):
                own = rows[label == k]
                counts[k] += len(own)
                total[k] += own.sum(axis=0)
                products[k] += own.T @ own
        for k in (0, 1):
            values = np.concatenate([counts[k : k + 1], total[k], products[k].ravel()])
            yield pa.record_batch(
                [pa.array([k] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)],
                names=["label", "place", "value"],
            )

    added = joined.mapInArrow(moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + size + size * size))
    for r in added.collect():  # two rows for each pair of statistics
        sums[r.label, r.place] = r.value
    return fit(sums[:, 0], sums[:, 1 : 1 + size], sums[:, 1 + size :].reshape(2, size, size), to_pooled, to_diagonal)


def score(measured: DataFrame, model: Gaussians) -> DataFrame:
    """The measured rows with ``score`` in place of ``stats``."""
    kept = Kept(measured.sparkSession, model, Scorer)
    others = [c for c in measured.columns if c != "stats"]
    chosen = measured.select(*others, "stats")
    schema = chosen.drop("stats").schema

    def run(batches):
        scorer = kept.get()
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.record_batch([*batch.columns[:-1], pa.array(scorer.scores(rows))], names=[*batch.schema.names[:-1], "score"])

    return chosen.mapInArrow(run, schema.add("score", "double"))


def append(docs: DataFrame, model: Gaussians, name: str) -> DataFrame:
    """All columns of docs and the score of each text, measured and scored in one pass."""
    return append_scores(docs, name, Kept(docs.sparkSession, model, Scorer))


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(doc_id, score) of every row of docs; learned from labels (doc_id, label) that ``learn_from`` admits."""
    measured = written(measure(docs, ["doc_id"]), "quality")
    return score(measured, train(measured, labels.filter(learn_from)))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = classify(table(spark, sf_dir, "documents"), labels, ~in_fold(3, 1))
    return scored.select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
