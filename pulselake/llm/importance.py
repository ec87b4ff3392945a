"""Importance resampling towards a target: weights from hashed n-gram counts, then an exact distributed ranking.

Words and their hashes come from the bytes of a whole Arrow batch by array operations: CRC-32 is linear, so the CRC of two
words with a space between them is combined from those of the words. Counts of ``BUCKETS`` buckets are added up
over all rows of the corpus and of the target; each bucket's gain is one number, and a document's weight is the floored mean of
its features' gains. A weight plus Gumbel noise from the id's digest, sorted, is a draw without replacement.

Ranks come by parallel sorting by regular sampling. Runs are sorted on their own and give regular samples, which
are merged and sampled again in a tree until one list of splitters is left. Rows are exchanged by the splitters,
segments merge locally, and the counts of the segments before it make a segment's ranks exact. The key of a row
is (score, id, row number), so ties of any number are split.

Defined cases: null texts have no features and weight 0; documents under ``least_words`` words take no part in the draw and
have a null rank. A null id is hashed as an empty one and stands last among equal scores; rows that share an id are ranked
each for itself. Empty tables give empty counts or no rows. Extra columns are ignored. The driver holds counts and gains of the
buckets, ``SPLITTERS`` splitters for each segment and a count for each segment, of ``SEGMENT_ROWS`` rows or more.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import Kept, table, written
from pulselake.llm.words import byte_spans, lower_ascii, spans, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 7
SLICE_BYTES = 4_000_000
SEGMENT_ROWS = 500_000
SPLITTERS = 8  # samples that a list of splitters holds for each segment
FAN = 32
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 step for a byte, and for each power of two the linear map that appends that many zero bytes, by
    the four bytes of the register."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    step = np.zeros((4, 256), np.uint32)
    for place in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        step[place] = byte[register & 255] ^ (register >> np.uint32(8))
    powers = [step]
    for _ in range(40):
        powers.append(np.stack([_append(powers[-1], row) for row in powers[-1]]))
    return byte, np.stack(powers)


def _append(power: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = power[0][register & 255]
    for place in range(1, 4):
        out = out ^ power[place][(register >> np.uint32(8 * place)) & 255]
    return out


_BYTE, _POWERS = _crc_tables()


def after_zeros(register: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC registers after as many zero bytes."""
    out, left, power = register.copy(), counts.copy(), 0
    while (odd := np.flatnonzero(left)).size:
        now = odd[(left[odd] & 1) == 1]
        out[now] = _append(_POWERS[power], out[now])
        left >>= 1
        power += 1
    return out


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """zlib.crc32 of every stretch of bytes; a step for each byte of the longest that is left, on all of them."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -64, side="left"))  # those of over 64 bytes go one by one
    for i in range(long):
        register[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes()) ^ 0xFFFFFFFF
    live = np.searchsorted(-size, -np.arange(65), side="left")  # live[k]: how many have more than k bytes
    for k in range(64):
        some = slice(long, int(live[k]))
        if some.start >= some.stop:
            break
        r = register[some]
        register[some] = _BYTE[(r ^ data[begin[some] + k]) & 255] ^ (r >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, how many each text has, and its number of words."""
    data, begins, ends = text_bytes(column)
    data = lower_ascii(data)
    starts, stops, owner = spans(IN_WORD[data], begins, ends)
    lengths = stops - starts
    one = crcs(data, starts, lengths)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    # crc(a + " " + b): what stands before b enters as its register after b's length of zero bytes
    before = one[pairs] ^ np.uint32(0xFFFFFFFF)
    before = (_BYTE[(before ^ np.uint32(32)) & 255] ^ (before >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    two = after_zeros(before, lengths[pairs + 1]) ^ one[pairs + 1]
    n_words = np.bincount(owner, minlength=len(begins))
    n_pairs = np.bincount(owner[pairs], minlength=len(begins))
    of = np.concatenate([owner, owner[pairs]])
    order = np.argsort(of, kind="stable")
    return (np.concatenate([one, two]) % np.uint32(BUCKETS))[order].astype(np.int64), n_words + n_pairs, n_words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; a row for each bucket comes to the driver."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in byte_spans(batch.column(0), SLICE_BYTES):
                counts += np.bincount(features(batch.column(0).slice(a, b - a))[0], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    totals = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        totals[bucket] = n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus) of each bucket."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (s_all + len(corpus))) / ((s + 1) * (t_all + len(corpus)))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    kept = Kept(docs.sparkSession, gain, lambda value: value)

    def run(batches):
        value = kept.get()
        for batch in batches:
            for a, b in byte_spans(batch.column(1), SLICE_BYTES):
                found, n, n_words = features(batch.column(1).slice(a, b - a))
                total = np.append(0, np.cumsum(value[found]))
                ends = np.cumsum(n)
                weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln u)) with u in (0, 1) from the first 32 bits of the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _keys(batch) -> np.ndarray:
    """Rows as byte strings that sort as (score descending, id with null last, row)."""
    score, row = batch["score"].to_numpy(zero_copy_only=False), batch["row"].to_numpy(zero_copy_only=False)
    ids = batch["doc_id"]
    unnamed = np.asarray(ids.is_null())
    named = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(score), 25), np.uint8)
    for place, values in ((0, ~score), (9, named), (17, row)):
        shifted = values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, place : place + 8] = shifted.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = unnamed
    return out.view("S25").ravel()


def _regular(keys: np.ndarray, weights: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` of the sorted keys at equal steps of weight, each with the weight up to it."""
    if len(keys) <= count:
        return keys, weights
    total = np.cumsum(weights)
    at = np.unique(np.searchsorted(total, total[-1] * (np.arange(count) + 1) / count - 0.5).clip(0, len(keys) - 1))
    return keys[at], np.diff(total[at], prepend=0)


def _packed(keys: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([keys.tobytes()], pa.binary()), pa.array([weights.astype("<i8").tobytes()], pa.binary())], names=["keys", "weights"])


def _merged(rows) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, "S25") for k, _ in rows])
    weights = np.concatenate([np.frombuffer(w, "<i8") for _, w in rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], weights[order]


def splitters(runs: DataFrame, segments: int) -> np.ndarray:
    """Keys that cut all rows of the sorted runs (run, score, doc_id, row) into about equal segments."""
    count = SPLITTERS * segments

    def sample(group: pa.Table) -> pa.Table:
        keys = np.sort(_keys(group.combine_chunks()))
        taken = _packed(*_regular(keys, np.ones(len(keys), np.int64), count))
        return pa.Table.from_batches([taken.append_column("run", group["run"].combine_chunks().slice(0, 1))])

    def again(group: pa.Table) -> pa.Table:
        taken = _packed(*_regular(*_merged(list(zip(group["keys"].to_pylist(), group["weights"].to_pylist()))), count))
        return pa.Table.from_batches([taken.append_column("run", group["run"].combine_chunks().slice(0, 1))])

    schema = "keys binary, weights binary, run int"
    samples, left = written(runs.groupBy("run").applyInArrow(sample, schema), "samples"), segments
    while left > FAN:
        left = -(-left // FAN)
        samples = written(samples.withColumn("run", F.floor(F.col("run") / FAN).cast("int")).groupBy("run").applyInArrow(again, schema), "samples")
    rows = samples.select("keys", "weights").collect()
    if not rows:
        return np.zeros(0, "S25")
    keys, weights = _merged(rows)
    total = np.cumsum(weights)
    at = np.searchsorted(total, total[-1] * np.arange(1, segments) / segments).clip(0, len(keys) - 1)
    return keys[np.unique(at)]


def ranked(scored: DataFrame, share: int = 25, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, rank) of the floor(share * N / 100) first of the N rows of (row, doc_id, n_words, score) that have enough words."""
    able = scored.filter(F.col("n_words") >= least_words).select("row", "doc_id", "score")
    total = able.count()
    segments = max(1, -(-total // SEGMENT_ROWS))
    runs = able.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(segments)).cast("int"))
    cuts = Kept(scored.sparkSession, splitters(runs, segments), lambda value: value)

    def send(batches):
        bounds = cuts.get()
        for batch in batches:
            segment = np.searchsorted(bounds, _keys(batch), side="left")
            yield pa.record_batch([pa.array(segment, pa.int32()), *batch.columns], names=["segment", *batch.schema.names])

    exchanged = written(able.mapInArrow(send, "segment int, row bigint, doc_id bigint, score bigint"), "segments")
    counts = dict(exchanged.groupBy("segment").count().collect())
    drawn, base, start = share * total // 100, {}, 0
    for segment in sorted(counts):
        base[segment] = start
        start += counts[segment]
    bases = Kept(scored.sparkSession, base, lambda value: value)

    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.argsort(_keys(group), kind="stable")
        first = bases.get()[group["segment"][0].as_py()]
        ranks = first + 1 + np.arange(len(order))
        order = order[: max(0, drawn - first)]
        return pa.table({"row": group["row"].take(pa.array(order)), "rank": pa.array(ranks[: len(order)], pa.int64())})

    wanted = [segment for segment in base if base[segment] < drawn]
    last = max(wanted, default=-1)
    return exchanged.filter(F.col("segment") <= last).groupBy("segment").applyInArrow(merge, "row bigint, rank bigint")


def resample(docs: DataFrame, target: DataFrame, share: int = 25) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), towards the texts of target."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = weigh(docs, gain).withColumn("score", F.col("weight") + noise())
    scored = written(weighed.withColumn("row", F.monotonically_increasing_id()), "weights")
    ranks = ranked(scored, share)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
