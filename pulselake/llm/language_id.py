"""Language of a text by a string kernel.

A text is seen as the set of its n-grams of one to three letters, case ignored, within words; three-letter n-grams also
take the edge of a word. The ``OWN_LETTERS`` commonest letters of the landmarks have classes of their own, all others share
``SHARED`` classes by hash. Two texts compare by the number of n-grams they share over the root of the product of their set
sizes, in which n-grams count that some landmark has. Landmark texts give the Nyström features of this kernel, and one ridge regression per language, against the
rest, scores them. Scoring a batch is two matrix products.

The model is fitted on a sample of labelled rows, ``landmarks`` and ``samples`` per language at most, chosen by hash of
the id. Every row is scored from its whole text. Null texts and texts without a letter are ``und`` with score 0; where
nothing could be learned, every text is. Rows with null or repeated ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import Kept, code_points, in_fold, slices, table

UNDETERMINED = "und"
EDGE, SHARED, OWN_LETTERS = 0, 14, 110
SLICE_CHARS, SLICE_CELLS = 1_000_000, 6_000_000


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _kinds(letters: str) -> np.ndarray:
    """The class of every code point: the edge of a word, one of those that unlisted letters share, or a listed letter's."""
    shared = 1 + (np.arange(0x110000, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(16)) % SHARED
    kinds = np.where(_is_letter(), shared, EDGE).astype(np.uint8)
    for i, c in enumerate(letters):
        kinds[ord(c)] = SHARED + 1 + i
    return kinds


def _grams(texts: list[str], kinds: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and the text of each; with repeats."""
    folded = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in folded], np.int64)
    kind = kinds[code_points([f" {t} " for t in folded])].astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = kind > EDGE
    keep[1:] |= kind[:-1] > EDGE
    keep[0] = True
    kind, owner = kind[keep], owner[keep]
    left, middle, right = kind[:-2], kind[1:-1], kind[2:]
    inside = middle > EDGE
    three = (left * base + middle) * base + right
    two = base**3 + middle * base + right
    one = base**3 + base**2 + middle
    pair = inside & (right > EDGE)
    codes = np.concatenate([three[inside], two[pair], one[inside]])
    return codes, np.concatenate([owner[1:-1][inside], owner[1:-1][pair], owner[1:-1][inside]])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    letters: str
    vocabulary: np.ndarray  # the n-grams of the landmarks, sorted
    landmarks: np.ndarray  # n-grams x landmarks, 0 or 1
    weights: np.ndarray  # landmarks x languages, norms of the landmarks and Nyström map included
    bias: np.ndarray


class Scorer:
    """A model made ready in a worker."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.base = len(model.letters) + SHARED + 1
        self.kinds = _kinds(model.letters)
        self.row = np.full(self.base**3 + self.base**2 + self.base, -1, np.int32)
        self.row[model.vocabulary] = np.arange(len(model.vocabulary))
        self.landmarks = model.landmarks.astype(np.float32)
        self.weights = model.weights.astype(np.float32)

    def presence(self, texts: list[str]) -> np.ndarray:
        codes, owner = _grams(texts, self.kinds, self.base)
        rows = self.row[codes]
        seen = rows >= 0
        size = len(self.model.vocabulary)
        present = np.zeros(len(texts) * size, np.float32)
        present[owner[seen].astype(np.int64) * size + rows[seen]] = 1
        return present.reshape(len(texts), size)

    def kernel(self, texts: list[str]) -> np.ndarray:
        present = self.presence(texts)
        size = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.landmarks) / size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and a score from 0 to 1."""
        languages, found, scores = self.model.languages, [], np.zeros(len(texts))
        cells = max(1, SLICE_CELLS // max(1, len(self.model.vocabulary)))
        for a, b in slices([len(t) for t in texts], SLICE_CHARS, cells):
            part = texts[a:b]
            letter = _is_letter()
            lettered = [bool(t) and (t.isalpha() or letter[code_points([t])].any()) for t in part]
            if not languages:
                found += [UNDETERMINED] * len(part)
                continue
            margin = self.kernel(part) @ self.weights + self.model.bias
            best = margin.argmax(axis=1)
            scores[a:b] = np.where(lettered, np.clip((margin.max(axis=1) + 1) / 2, 0, 1), 0)
            found += [languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered)]
        return found, scores


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float = 1e-3) -> LanguageModel:
    """A model from labelled texts; the first ``landmarks`` texts of each language are its landmarks."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        none = np.zeros(0)
        return LanguageModel((), "", none.astype(np.int64), none.reshape(0, 0), none.reshape(0, 0), none)
    chosen, count = [], dict.fromkeys(languages, 0)
    for i, label in enumerate(labels):
        if count[label] < landmarks:
            count[label] += 1
            chosen.append(i)
    marks = [texts[i] for i in chosen]
    frequency: dict[str, int] = {}
    for text in marks:
        for c in set(text.lower()):
            if c.isalpha():
                frequency[c] = frequency.get(c, 0) + 1
    letters = "".join(sorted(sorted(frequency, key=lambda c: (-frequency[c], c))[:OWN_LETTERS]))
    base = len(letters) + SHARED + 1
    codes, owner = _grams(marks, _kinds(letters), base)
    vocabulary, column = np.unique(codes, return_inverse=True)
    present = np.zeros((len(vocabulary), len(marks)), np.uint8)
    present[column, owner] = 1
    norms = np.sqrt(np.maximum(present.sum(axis=0), 1))

    blank = np.zeros((len(marks), 0))
    scorer = Scorer(LanguageModel(languages, letters, vocabulary, present, blank, np.zeros(0)))
    cells = max(1, SLICE_CELLS // max(1, len(vocabulary)))
    parts = [scorer.kernel(texts[a:b]) / norms for a, b in slices([len(t) for t in texts], SLICE_CHARS, cells)]
    kernel = np.concatenate(parts).astype(np.float64)
    among = kernel[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    sound = values > 1e-6 * max(values.max(), 1e-12)
    nystrom = vectors[:, sound] / np.sqrt(values[sound])
    features = kernel @ nystrom
    mean = features.mean(axis=0)
    centred = features - mean
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = np.array([1.0 / labels.count(x) for x in labels]) * len(labels) / len(languages)
    gram = (centred * balance[:, None]).T @ centred + ridge * len(labels) * np.eye(centred.shape[1])
    solved = np.linalg.solve(gram, (centred * balance[:, None]).T @ target)
    bias = (target * balance[:, None]).mean(axis=0) - mean @ solved
    return LanguageModel(languages, letters, vocabulary, present, (nystrom @ solved) / norms[:, None], bias)


def train(
    docs: DataFrame,
    learn_from: Column,
    landmarks: int = 40,
    samples: int = 300,
    max_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """A model from at most ``samples`` rows a language of those that ``learn_from`` admits.

    Texts over ``max_chars`` characters are not sampled, so that the sample stays small on the driver.
    """
    able = docs.filter(learn_from & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars))
    rows = able.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"))  # a row for each language, which the model holds anyway
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    near = rows.select("id", "h", "l").join(F.broadcast(sizes), "l").filter(share * F.col("n") < 4 * samples + 100)
    order = Window.partitionBy("l").orderBy("h", "id")  # of about four times the rows that are wanted
    picked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= samples).select("id").distinct()
    got = rows.join(F.broadcast(picked), "id", "left_semi").select("h", "t", "l").collect()  # samples x languages rows at most
    got = sorted(got, key=lambda r: (r.h, r.l, r.t))
    return fit([r.t for r in got], [r.l for r in got], landmarks)


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (named apart from lang_pred and score) with ``lang_pred`` and ``score`` of the whole text."""
    kept = Kept(docs.sparkSession, model, Scorer)
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = chosen.drop("_text").schema

    def run(batches):
        scorer = kept.get()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, scores = scorer.predict(texts)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return chosen.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~in_fold(3, 1))
    return predict(docs, model, ["doc_id", in_fold(3, 1).alias("held_out")])
