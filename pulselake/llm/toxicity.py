"""Toxicity of a text by a convolutional network over hashed word embeddings.

Words are lower-case runs of letters. A word's bucket (``BUCKETS`` of them, by hash) has a vector; buckets met in fewer
than ``MIN_TEXTS`` training texts share the zero vector. Filters of one, two and three words slide over the vectors,
each filter's largest value over the whole text goes into a logistic output. The words known and first weights come from
Adam in numpy on a bounded sample; then tasks go on from there over all labelled texts, and their weights are averaged
by the texts they saw. Texts stay where they are read: labels meet their words as rows of the vectors. Of the labelled documents a part by hash (``ASIDE``) teaches nothing: from exact counts over all of it
a threshold is set for each language, as found from the text; the score is moved so that the threshold of the text's
language lies at ``CUT``.

Null and empty texts are texts without words. Labels that are null or of an id without document are ignored; of an
id with several labels each counts. Without both classes in the sample every score is the share of label 1, or 0.
Rows with null or repeated ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.llm import language_id
from pulselake.llm.common import Kept, append_scores, in_fold, slices, table

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 24
MIN_TEXTS = 3
CUT = 0.3
WIDTHS = (1, 2, 3)
SLICE_CHARS = 300_000
CACHE_WORDS = 150_000
ASIDE = 5  # one of so many labelled documents sets thresholds
FEW = 50  # labelled documents up to which all of them teach and set thresholds
BINS = 1000  # of logits by one
BLOCK = 1 << 12  # weights averaged together
MARKS = 1 << 26  # bits in which labelled ids are marked by hash: 8 MB, whatever the number of labels


class _Rows(dict):
    """The vector's row of a word, remembered."""

    def __init__(self, of_bucket: dict[int, int]):
        super().__init__()
        self.of_bucket = of_bucket

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        row = self[word] = self.of_bucket.get(bucket(word), 0)
        return row


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % BUCKETS


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Network:
    """Row 0 of the vectors is zero; filters by width, each (width x size) x filters."""

    buckets: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float
    cuts: dict[str, float] = field(default_factory=dict)  # logit threshold by language
    constant: float | None = None

    def convolve(self, rows: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Filter values at each position of texts laid one after the other with zero rows between.

        Where a filter would reach into the next text its value is minus infinity.
        """
        x, values = self.vectors[rows], []
        for width, weights, offset in zip(WIDTHS, self.filters, self.offsets):
            n, size = len(rows) - width + 1, x.shape[1]
            total = x[:n] @ weights[:size]
            for k in range(1, width):
                total += x[k : k + n] @ weights[k * size : (k + 1) * size]
            total += offset
            for k in range(1, width):
                total[starts[1:] - k] = -np.inf
            values.append(total)
        return values


def rows_of(net: Network) -> _Rows:
    return _Rows({int(b): i + 1 for i, b in enumerate(net.buckets)})


GAP = max(WIDTHS)


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all texts with ``GAP`` zero rows after each, and where each text starts."""
    sizes = np.array([len(t) + GAP for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = np.zeros(int(sizes.sum()), np.int32)
    for start, text in zip(starts.tolist(), texts):
        rows[start : start + len(text)] = text
    return rows, starts


class Scorer:
    def __init__(self, models: tuple[Network, language_id.LanguageModel]):
        self.network, language = models
        self.language = language_id.Scorer(language)
        self.rows = rows_of(self.network)

    def word_rows(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.rows.__getitem__, found), np.int32, len(found))

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            rows, starts = lay_out([self.word_rows(t) for t in texts[a:b]])
            pooled = [np.maximum(np.maximum.reduceat(v, np.minimum(starts, len(v) - 1), axis=0), 0) for v in self.network.convolve(rows, starts)]
            out[a:b] = np.concatenate(pooled, axis=1) @ self.network.out + self.network.bias
        return out

    def text_scores(self, texts: list[str]) -> np.ndarray:
        if self.network.constant is not None:
            return np.full(len(texts), self.network.constant)
        languages, _ = self.language.predict(texts)
        default = self.network.cuts[""]
        cuts = np.array([self.network.cuts.get(x, default) for x in languages])
        moved = self.logits(texts) - cuts + np.log(CUT / (1 - CUT))
        # At the threshold itself rounding must not put the score below the cut.
        return np.round(1 / (1 + np.exp(-np.clip(moved, -500, 500))), 12)


def _threshold(values: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> float:
    """The middle of the gap between neighbouring values at which F1 is greatest; texts of label 1 and all texts by value."""
    order = np.argsort(-values, kind="stable")
    value, hit, found = values[order], np.cumsum(ones[order]), np.cumsum(totals[order])
    f1 = 2 * hit / (found + ones.sum())
    k = int(f1.argmax())
    return float((value[k] + value[k + 1]) / 2) if k + 1 < len(value) else float(value[k] - 1)


def _cuts(languages: np.ndarray, values: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> dict[str, float]:
    """Thresholds by language; that of all texts, under no name, is for languages with fewer than 10 texts of a label."""
    cuts = {"": _threshold(values, ones, totals) if ones.any() else 0.0}
    for name in sorted(set(languages.tolist())):
        own = languages == name
        if ones[own].sum() >= 10 and (totals[own] - ones[own]).sum() >= 10:
            cuts[name] = _threshold(values[own], ones[own], totals[own])
    return cuts


def descend(
    net: Network, coded: list[np.ndarray], y: np.ndarray, train: np.ndarray, rounds: int, batch: int, dropped: float, speed: float,
    rng: np.random.Generator,
) -> None:
    """Adam over the texts ``train`` in batches, in place; a share of the words is hidden at each step."""
    size, filters = net.vectors.shape[1], net.filters[0].shape[1]
    weights = [net.vectors, *net.filters, *net.offsets, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    bias_first = bias_second = 0.0
    step = 0
    for _ in range(rounds):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            chosen = train[at : at + batch]
            rows, starts = lay_out([coded[i] for i in chosen])
            rows[rng.random(len(rows)) < dropped] = 0
            ends = np.append(starts[1:], len(rows))
            values = net.convolve(rows, starts)
            places = [np.stack([a + v[a : min(b, len(v))].argmax(axis=0) for a, b in zip(starts, ends)]) for v in values]
            columns = np.arange(filters)
            pooled = np.concatenate([np.maximum(v[p, columns], 0) for v, p in zip(values, places)], axis=1)
            logit = pooled @ net.out + net.bias
            error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[chosen]) / len(chosen)).astype(np.float32)
            back = (error[:, None] * net.out) * (pooled > 0)
            grads = [np.zeros_like(w) for w in weights]
            grads[-1][:] = error @ pooled
            for k, (width, p) in enumerate(zip(WIDTHS, places)):
                own = back[:, k * filters : (k + 1) * filters]
                grads[1 + len(WIDTHS) + k][:] = own.sum(axis=0)
                for j in range(width):
                    here = rows[p + j]  # texts x filters
                    block = slice(j * size, (j + 1) * size)
                    grads[1 + k][block] = np.einsum("tf,tfs->sf", own, net.vectors[here])
                    np.add.at(grads[0], here.ravel(), (own[:, :, None] * net.filters[k][block].T[None]).reshape(-1, size))
            grads[0][0] = 0
            step += 1
            rate = speed * (1 - 0.9**step) ** -1 * (1 - 0.999**step) ** 0.5
            for w, g, m, s in zip(weights, grads, first, second):
                g += 1e-5 * w
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
            g = float(error.sum())
            bias_first += 0.1 * (g - bias_first)
            bias_second += 0.001 * (g * g - bias_second)
            net.bias -= rate * bias_first / (bias_second**0.5 + 1e-8)
            net.vectors[0] = 0


def fit(
    texts: list[str],
    labels: list[int],
    language: language_id.LanguageModel,
    size: int = 12,
    filters: int = 16,
    steps: int = 1500,
    batch: int = 64,
    dropped: float = 0.3,
    seed: int = 7,
) -> Network:
    """Train on four fifths of the texts, set thresholds on the others. A share of the words is hidden at each step."""
    y = np.array(labels, np.float64)
    none = np.zeros((1, size), np.float32)
    empty = Network(np.zeros(0, np.int64), none, [], [], np.zeros(0), 0.0, {}, float(y.mean()) if len(y) else 0.0)
    if not 0 < y.sum() < len(y):
        return empty
    seen: dict[int, int] = {}
    found = [[bucket(w) for w in words(t)] for t in texts]
    for one in found:
        for b in set(one):
            seen[b] = seen.get(b, 0) + 1
    known = np.array(sorted(b for b, n in seen.items() if n >= MIN_TEXTS), np.int64)
    row_of = {int(b): i + 1 for i, b in enumerate(known)}
    coded = [np.array([row_of.get(b, 0) for b in one], np.int32) for one in found]

    rng = np.random.default_rng(seed)
    net = Network(
        known,
        np.concatenate([none, rng.normal(0, 0.1, (len(known), size)).astype(np.float32)]),
        [rng.normal(0, (2 / (w * size)) ** 0.5, (w * size, filters)).astype(np.float32) for w in WIDTHS],
        [np.full(filters, -0.1, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, filters * len(WIDTHS)).astype(np.float32),
        float(np.log(y.mean() / (1 - y.mean()))),
    )
    order = rng.permutation(len(coded))
    aside = order[::5] if len(order) >= 50 else order
    train = np.setdiff1d(order, aside) if len(order) >= 50 else order
    descend(net, coded, y, train, -(-steps * batch // len(train)), batch, dropped, 0.01, rng)

    scorer = Scorer((net, language))
    held = [texts[i] for i in aside]
    logits, truth = scorer.logits(held), y[aside]
    languages = np.array(scorer.language.predict(held)[0])
    net.cuts = _cuts(languages, logits, truth, np.ones(len(truth)))
    return net


def _flat(net: Network) -> list[np.ndarray]:
    return [net.vectors, *net.filters, *net.offsets, net.out]


def _pack(rows: list[int]) -> bytes:
    """Row numbers with their byte planes apart, which compresses well."""
    return np.ascontiguousarray(np.array(rows, "<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def hashed(name: str, id_type: T.DataType, modulus: int) -> Column:
    """An id's hash; ids are hashed in the type that labels have."""
    return F.pmod(F.xxhash64(F.col(name).try_cast(id_type)), F.lit(modulus))


def marks(known: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids (_id) of labels. Where many share a bit, more texts are made ready in vain; the join decides."""
    bit = hashed("_id", known.schema["_id"].dataType, MARKS) + 1
    found = known.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in found.collect():  # ``MARKS`` bits at most
        bits[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits


def _marked(batches, bits: np.ndarray):
    """Of batches with the hash in their last column, the rows whose bit is set, without that column."""
    for batch in batches:
        at = batch.column(batch.num_columns - 1).to_numpy()
        chosen = (bits[at >> 3] >> (at & 7)) & 1 == 1
        if chosen.any():
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(chosen))


def coded(texts: DataFrame, net: Network, bits: Broadcast) -> DataFrame:
    """(doc_id, at, chars, words) of the marked texts (doc_id, text, mark): place and length of the text, its words as rows of the vectors."""
    kept = Kept(texts.sparkSession, net, rows_of)

    def run(batches):
        row_of = kept.get()
        for batch in _marked(batches, bits.value):
            found = [t or "" for t in batch.column(2).to_pylist()]
            packed = [_pack([row_of[w] for w in words(t)]) for t in found]
            yield pa.record_batch([*batch.columns[:2], pa.array([len(t) for t in found], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "at", "chars", "words"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.monotonically_increasing_id().alias("at"), "text", "mark").mapInArrow(run, f"doc_id {id_type}, at bigint, chars bigint, words binary")


def _portions(batches) -> Iterator[tuple[int, list[np.ndarray], list[int]]]:
    """Consecutive texts of a task that read them, with ``SLICE_CHARS`` characters at most or one text: task, texts, labels."""
    last, size, texts, labels = None, 0, [], []
    for batch in batches:
        for task, chars, packed, label in zip(*(c.to_pylist() for c in batch.columns)):
            if texts and (task != last or size + chars > SLICE_CHARS):
                yield last, texts, labels
                size, texts, labels = 0, [], []
            last, size = task, size + chars
            texts.append(_unpack(packed))
            labels.append(label)
    if texts:
        yield last, texts, labels


def refine(known: DataFrame, net: Network, batch: int = 64, dropped: float = 0.3, speed: float = 0.001) -> Network:
    """The network after one pass of all texts of ``known`` (at, chars, words, label): weights learned apart are averaged.

    Texts that one task read are learned from in their order, whatever the join before did to them. Weights go to the
    average in blocks, so that no task or driver gathers all networks.
    """
    start = known.sparkSession.sparkContext.broadcast(net)

    def learn(batches):
        for _, portions in groupby(_portions(batches), lambda p: p[0]):
            own, count, rng = copy.deepcopy(start.value), 0, np.random.default_rng(7)
            for _, texts, labels in portions:
                descend(own, texts, np.array(labels, np.float64), np.arange(len(texts)), 1, batch, dropped, speed, rng)
                count += len(texts)
            flat = np.concatenate([w.ravel() for w in _flat(own)]).astype("<f4")
            parts = [np.array([own.bias], "<f8").tobytes(), *(flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK))]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([count] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "weights"])

    def average(group: pa.Table) -> pa.Table:
        kind, total, count = "<f4" if group["block"][0].as_py() else "<f8", 0.0, 0
        for n, raw in sorted((n, raw) for n, raw in zip(group["n"].to_pylist(), group["weights"].to_pylist())):
            total, count = total + n * np.frombuffer(raw, kind).astype("<f8"), count + n
        return pa.table({"block": group["block"][:1], "weights": pa.array([(total / count).tobytes()], pa.binary())})

    task = F.shiftright("at", 33).alias("task")  # as numbered by monotonically_increasing_id
    ordered = known.select(task, "at", "chars", "words", "label").repartition("task").sortWithinPartitions("at", "label")
    learned = ordered.drop("at").mapInArrow(learn, "block int, n bigint, weights binary")
    mean = learned.groupBy("block").applyInArrow(average, "block int, weights binary").collect()  # the weights of one network
    if not mean:
        return net
    bias, *blocks = [np.frombuffer(r.weights, "<f8") for r in sorted(mean, key=lambda r: r.block)]
    flat, done, at = np.concatenate(blocks), copy.deepcopy(net), 0
    for w in _flat(done):
        w[...] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    done.bias = float(bias[0])
    return done


def placed(texts: DataFrame, models: tuple[Network, language_id.LanguageModel], bits: Broadcast) -> DataFrame:
    """(doc_id, lang, bin) of the marked texts (doc_id, text, mark): language as found, logit in steps of 1 / ``BINS``."""
    kept = Kept(texts.sparkSession, models, Scorer)

    def run(batches):
        scorer = kept.get()
        for batch in _marked(batches, bits.value):
            found = [t or "" for t in batch.column(1).to_pylist()]
            bins = np.floor(np.clip(scorer.logits(found), -50, 50) * BINS).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(list(scorer.language.predict(found)[0]), pa.string()), pa.array(bins)], names=["doc_id", "lang", "bin"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "mark").mapInArrow(run, f"doc_id {id_type}, lang string, bin int")


def whole_cuts(known: DataFrame, default: dict[str, float]) -> dict[str, float]:
    """Thresholds by language from counts of all texts of ``known`` (lang, bin, label), or the default without any."""
    counted = known.groupBy("lang", "bin").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("texts")).collect()  # as many as bins
    counted.sort()
    columns = [np.array([r[k] for r in counted]) for k in range(4)]
    return _cuts(columns[0], (columns[1] + 0.5) / BINS, columns[2].astype(np.float64), columns[3].astype(np.float64)) if counted else default


def train(
    docs: DataFrame, labels: DataFrame, learn_from: Column, samples: int = 3000, max_chars: int = 20_000
) -> tuple[Network, language_id.LanguageModel]:
    """From all labels (doc_id, label) that ``learn_from`` admits; a first network from at most ``samples`` of each label, by hash of the id.

    Texts over ``max_chars`` characters are not in that sample, which stays small on the driver; all others are learned from
    too, and set the thresholds. The language model learns from the same part of the documents.
    """
    language = language_id.train(docs, learn_from)
    known = labels.filter(learn_from).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    few = len(known.limit(FEW).collect()) < FEW
    id_type = labels.schema["doc_id"].dataType
    apart = hashed("_id", id_type, ASIDE) == 0
    taught = known if few else known.filter(~apart)
    picked = [taught.filter(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(samples) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    fits = docs.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text")
    sample = fits.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))  # twice ``samples`` rows at most
    got = sample.select(F.xxhash64("doc_id").alias("h"), "text", "_label").collect()
    got = list({r.text: r for r in sorted(got, key=lambda r: (r.h, r.text, r._label))}.values())  # copies teach nothing new
    net = fit([r.text for r in got], [r._label for r in got], language)
    if net.constant is not None:
        return net, language
    texts = docs.filter(learn_from).select("doc_id", "text", hashed("doc_id", id_type, MARKS).alias("mark"))
    own, bits = hashed("doc_id", id_type, ASIDE) == 0, docs.sparkSession.sparkContext.broadcast(marks(known))
    # Labels meet what was made of a text, not the text. By sort-merge whatever the size: shuffles grow with the input.
    labelled = lambda made, ids: made.hint("merge").join(ids, F.col("doc_id") == F.col("_id")).withColumnRenamed("_label", "label")
    net = refine(labelled(coded(texts if few else texts.filter(~own), net, bits), taught), net)
    judged = placed(texts if few else texts.filter(own), (net, language), bits)
    net.cuts = whole_cuts(labelled(judged, known if few else known.filter(apart)), {"": 0.0})
    return net, language


def score(docs: DataFrame, models: tuple[Network, language_id.LanguageModel], keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (named apart from score) with ``score`` of the whole text."""
    kept = Kept(docs.sparkSession, models, Scorer)
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = T.StructType([*chosen.drop("_text").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = kept.get()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(scorer.text_scores(texts), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return chosen.mapInArrow(run, schema)


def append(docs: DataFrame, models: tuple[Network, language_id.LanguageModel], name: str) -> DataFrame:
    """All columns of docs and the score of each text."""
    return append_scores(docs, name, Kept(docs.sparkSession, models, Scorer))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    models = train(docs, labels, ~in_fold(4, 2))
    scored = score(docs, models, ["doc_id", in_fold(4, 2).alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
