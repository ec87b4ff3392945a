"""Occurrences of benchmark passages in documents, by a positional inverted index.

The index is cut by documents: a row of it covers a block of whole documents and holds, for every word of the test set that
occurs there, the sorted positions, counted through the block with a free place between documents. Other words cannot be
part of a match and are counted only. A common word's postings so lie over all blocks, and no list is ever shuffled.

A phrase starts from the postings of its rarest word, by counts over all documents, less the word's place in the phrase;
these starts are intersected with the shifted lists of the other words, from the next rarest on, all phrases of a block
at once. Proximity matches start from the rarest word in the same way.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and empty texts have no words. Items
with a null id count under the empty id; items that share an id are one item. Documents are rows: repeated ids stay
repeated. The test set goes to the executors in shards of ``SHARD_BYTES`` of text at most, one shard after the other.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import Kept, expand, slices, table, written

WINDOW = 10
BLOCK_CHARS = 2_000_000
SHARD_BYTES = 16_000_000


def _word_bytes() -> bytes:
    """Bytes of words as they are, A-Z lower-cased, all others a space."""
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes(b if b in keep else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


WORD_BYTES = _word_bytes()


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Phrases:
    """Phrases of at most ``width`` words as term numbers; ``owner`` says whose each is."""

    def __init__(self, phrases: list[tuple[int, list[bytes]]]):
        self.terms = {t: i for i, t in enumerate(sorted({t for _, p in phrases for t in p}))}
        self.owner = np.array([o for o, _ in phrases], np.int64)
        self.sizes = np.array([len(p) for _, p in phrases], np.int64)
        self.words = np.full((len(phrases), max(self.sizes, default=1)), -1, np.int64)
        for i, (_, p) in enumerate(phrases):
            self.words[i, : len(p)] = [self.terms[t] for t in p]

    def by_rarity(self, counts: np.ndarray) -> np.ndarray:
        """For each phrase, the places of its words, the rarest word first."""
        frequency = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        return np.argsort(frequency, axis=1, kind="stable")


def windows(text: str | None, width: int) -> list[list[bytes]]:
    """Every ``width`` words in a row; the whole of a shorter text that has a word."""
    found = tokens(text)
    return [found[i : i + width] for i in range(max(1, len(found) - width + 1))] if found else []


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the index: ids, starts and word counts of the documents, terms with their counts, positions.

    The positions of a term follow those of the term before it, ascending and stored as differences.
    """
    kept = Kept(docs.sparkSession, terms, lambda x: x)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        number = kept.get()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], BLOCK_CHARS):
                sizes, coded, start, starts = [], [], 0, []
                for text in texts[a:b]:
                    found = tokens(text)
                    sizes.append(len(found))
                    starts.append(start)
                    start += len(found) + 1
                    coded.append(np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found)))
                    coded.append(_gap)
                flat = np.concatenate(coded)
                places = np.flatnonzero(flat >= 0)
                term = flat[places]
                order = np.argsort(term, kind="stable")
                term, places = term[order], places[order]
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(term)))
                steps = np.diff(places, prepend=0)
                steps[first] = places[first]
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                yield pa.record_batch(
                    [ids, one(starts, pa.int32()), one(sizes, pa.int32()), one(term[first], pa.int32()), one(counts, pa.int32()), one(steps, pa.int32())],
                    names=["ids", "starts", "sizes", "terms", "counts", "steps"],
                )

    schema = f"ids array<{id_type}>, starts array<int>, sizes array<int>, terms array<int>, counts array<int>, steps array<int>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


_gap = np.array([-1], np.int64)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term occurs in all documents; as many rows as the test set has words."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("p.terms", "p.counts")
    counts = np.zeros(n_terms, np.int64)
    for term, n in pairs.groupBy("terms").agg(F.sum("counts")).collect():
        counts[term] = n
    return counts


class Block:
    """A block's postings in memory."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda k: batch.column(k)[row].values
        self.ids = get(0)
        self.starts, self.sizes, terms, counts, steps = (get(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 6))
        self.span = int(self.starts[-1] + self.sizes[-1] + 1)
        begins = np.cumsum(counts) - counts
        total = np.cumsum(steps)
        before = np.where(begins > 0, total[begins - 1], 0) if len(begins) else begins
        places = total - np.repeat(before, counts)
        self.terms, self.begins, self.counts = terms, begins, counts
        self.places = places
        self.keys = np.repeat(terms, counts) * self.span + places  # ascending

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins, and its length; 0 for a term that is not there."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.begins[at], 0), np.where(there, self.counts[at], 0)

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the term stands at the place."""
        keys = terms * self.span + places
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (places >= 0) & (places < self.span)

    def phrases(self, phrases: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence."""
        rarest = order[:, 0]
        rows = np.arange(len(order))
        begins, lengths = self.find(phrases.words[rows, rarest])
        phrase = np.repeat(rows, lengths)
        start = self.places[expand(begins, lengths)] - rarest[phrase]
        for step in range(1, order.shape[1]):
            if not len(phrase):
                break
            place = order[phrase, step]
            inside = step < phrases.sizes[phrase]
            fits = ~inside | self.has(phrases.words[phrase, place], start + place)
            phrase, start = phrase[fits], start[fits]
        return phrase, start

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Starts of all spans of ``width`` places within a document that begin with a term and hold every one."""
        begins, lengths = self.find(terms)
        if not len(terms) or not lengths.all():
            return np.zeros(0, np.int64)
        lists = [self.places[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist())]
        lists.sort(key=len)
        rare = lists[0]
        first = np.concatenate([one[expand(np.searchsorted(one, rare - width + 1), np.searchsorted(one, rare, "right") - np.searchsorted(one, rare - width + 1))] for one in lists])
        first = np.unique(first)
        document = np.searchsorted(self.starts, first, side="right") - 1
        end = np.minimum(first + width, self.starts[document] + self.sizes[document])
        for one in lists:
            keep = np.searchsorted(one, first) < np.searchsorted(one, end)
            first, end = first[keep], end[keep]
        return first


MATCH = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"


def _match_shard(docs: DataFrame, items: list[tuple[str, str | None]], width: int, id_col: str, text_col: str) -> DataFrame:
    names = sorted({name for name, _ in items})
    place = {name: i for i, name in enumerate(names)}
    phrases = Phrases([(place[name], w) for name, text in items for w in windows(text, width)])
    index = written(build_index(docs, phrases.terms, id_col, text_col), "postings")
    order = phrases.by_rarity(term_counts(index, len(phrases.terms)))
    kept = Kept(docs.sparkSession, (names, phrases, order), lambda x: x)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names, phrases, order = kept.get()
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                n = len(block.ids)
                phrase, start = block.phrases(phrases, order) if len(order) else (np.zeros(0, np.int64),) * 2
                edge = np.zeros(block.span + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + phrases.sizes[phrase], -1)
                hit = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(hit, prepend=False, append=False))
                opens, closes = turn[::2], turn[1::2]
                owner = np.searchsorted(block.starts, opens, side="right") - 1
                per_doc = np.bincount(owner, minlength=n)
                offsets = pa.array(np.append(0, np.cumsum(per_doc)), pa.int32())
                spans = pa.StructArray.from_arrays(
                    [pa.array(opens - block.starts[owner], pa.int32()), pa.array(closes - block.starts[owner], pa.int32())], names=["start", "end"]
                )
                pair = np.unique((np.searchsorted(block.starts, start, side="right") - 1) * max(1, len(names)) + phrases.owner[phrase])
                of, item = np.divmod(pair, max(1, len(names)))
                found = np.bincount(of, minlength=n)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(found)), pa.int32()), pa.array([names[i] for i in item.tolist()], pa.string())
                )
                yield pa.record_batch(
                    [block.ids, pa.array(block.sizes, pa.int64()), pa.ListArray.from_arrays(offsets, spans), listed],
                    names=[id_col, "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, f"`{id_col}` {id_type}, {MATCH}")


def match(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, n_words, spans, items) of every document: spans of words inside occurrences of ``width`` item words in a
    row, and the ids, as text, of the items that have any."""
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    if shards == 1:
        return _match_shard(docs, [tuple(r) for r in named.collect()], width, id_col, text_col)
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col), "numbered")
    parts = []
    for k in range(shards):
        own = named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        part = _match_shard(rows, [tuple(r) for r in own.collect()], width, "_row", text_col)
        parts.append(part)
    merged = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return rows.select("_row", id_col).join(merged, "_row").drop("_row")


def hit_words() -> Column:
    """The number of words within ``spans``, each counted once; spans are sorted by start."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).cast("bigint").alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate("spans", start, step)["n"]


def report(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return matched.select(
        id_col,
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def near_matches(
    docs: DataFrame, queries: dict[str, list[str]], width: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, query, start) of every span of ``width`` words that begins with a word of the query and holds all of them.

    Queries are lists of words in any order, repeats ignored; a query with a word that no document holds has no match.
    """
    coded = {q: sorted({t for w in ws for t in tokens(w)}) for q, ws in queries.items()}
    terms = {t: i for i, t in enumerate(sorted({t for ts in coded.values() for t in ts}))}
    asked = [(q, np.array([terms[t] for t in ts], np.int64)) for q, ts in coded.items()]
    index = written(build_index(docs, terms, id_col, text_col), "postings")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                for query, wanted in asked:
                    start = block.near(wanted, width)
                    owner = np.searchsorted(block.starts, start, side="right") - 1
                    yield pa.record_batch(
                        [block.ids.take(pa.array(owner)), pa.array([query] * len(start), pa.string()), pa.array(start - block.starts[owner], pa.int32())],
                        names=[id_col, "query", "start"],
                    )

    return index.mapInArrow(run, f"`{id_col}` {id_type}, query string, start int")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


# A window occurs where its words, each between spaces, stand in the words of the document, each between spaces; the
# places before the occurrence are counted by the spaces.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, s.n, item FROM spots s JOIN items USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
