"""Collocations: phrases of two to five words that occur more often than their parts let expect, for each language.

Passes over the texts count words and then phrases. Each task counts in a trie of hash containers: bytes of the ids
of a phrase's first words lead down a shallow trie, and a container at its leaf holds the hashes of the phrases below
with their counts. A container that grows over ``BURST`` entries bursts into a node of 256 smaller ones. When the trie
holds ``HELD`` entries, its largest subtrees are spilled whole, as sorted runs by prefix partition, until half are left.
A partition merges its runs and keeps what occurs ``least`` times. The partition is chosen by the first four words of a
phrase, so what one prefix can add to it is bounded by the vocabulary, and repeats are counted before they are sent.

A phrase is frequent only if all pairs in it are, and a pair only if both words are. So a pass between counts pairs of frequent
words by hash bucket, and phrases are cut at pairs whose bucket is not frequent. Bitmaps of fixed size carry both
answers; a false yes costs time and nothing else, so results are exact however full the bitmaps are. A last pass fetches the
texts of the words that the result names.

A word's id is a 64-bit hash; a phrase is known by the id of all but its last word and the id of that, 128 bits. Frequent ids
that two words share, by a second hash, and ids that two frequent phrases share are looked for, and another seed
is taken if there are any.

Defined cases: a null text is empty, a null lang is ``und``, equal to a lang of that name. Repeated rows count each time. Ids and
extra columns are ignored. Empty tables give no rows. Scores are exact; numbers over 38 digits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from pulselake.llm.common import Kept, table, written
from pulselake.llm.words import byte_spans, lower_ascii, mix, spans, text_bytes, word_hashes

LONGEST = 5
LEAST = 100
FIRST = 2000
SLICE_BYTES = 1_000_000
BURST = 8_192
HELD = 500_000
PART_WORDS = 1_000_000
BITMAP_BITS = {1: 24, 2: 26}
BLOCK_BITS = 14
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Container:
    """Counts of phrases by hash: settled entries, each once, and those that came since."""

    def __init__(self, level: int):
        self.level, self.settled, self.size, self.new, self.waiting = level, None, 0, [], 0

    def add(self, entries: tuple) -> int:
        """How many entries more are held now."""
        self.new.append(entries)
        self.waiting += len(entries[0])
        return self.settle() if self.waiting > max(self.size, 4096) else 0

    def settle(self) -> int:
        before = self.size
        if self.new:
            parts = [self.settled, *self.new] if self.settled else self.new
            self.settled = counted(*map(np.concatenate, zip(*parts)))
            self.size, self.new, self.waiting = len(self.settled[0]), [], 0
        return self.size - before


def counted(path: np.ndarray, parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple:
    """Each phrase once with its counts added up, by hash."""
    order = np.argsort(mix(parent, word))
    path, parent, word = path[order], parent[order], word[order]
    hashes = mix(parent, word)
    new = (parent[1:] != parent[:-1]) | (word[1:] != word[:-1]) | (path[1:] != path[:-1])
    if (new & (hashes[1:] == hashes[:-1])).any():  # two phrases of one hash
        again = np.lexsort((path, word, parent))
        order, path, parent, word = order[again], path[again], parent[again], word[again]
        new = (parent[1:] != parent[:-1]) | (word[1:] != word[:-1]) | (path[1:] != path[:-1])
    first = np.flatnonzero(np.append(True, new)) if len(order) else order
    return path[first], parent[first], word[first], np.add.reduceat(count[order], first) if len(first) else count


class HatTrie:
    """A trie over bytes of word ids whose leaves are containers; ``spill`` takes whole subtrees out."""

    def __init__(self):
        self.root, self.held = {}, 0

    def add(self, path: np.ndarray, parent: np.ndarray, word: np.ndarray) -> None:
        if len(path):
            self._descend(self.root, 0, counted(path, parent, word, np.ones(len(path), np.int64)))

    def _descend(self, node: dict, level: int, entries: tuple) -> None:
        byte = ((entries[0] >> np.uint64(56 - 8 * level)) & np.uint64(255)).astype(np.uint8)
        order = np.argsort(byte, kind="stable")
        entries = tuple(x[order] for x in entries)
        ends = np.cumsum(np.bincount(byte, minlength=256)).tolist()
        begin = 0
        for key, end in enumerate(ends):
            if end > begin:
                self._into(node, key, level + 1, tuple(x[begin:end] for x in entries))
            begin = end

    def _into(self, node: dict, key: int, level: int, entries: tuple) -> None:
        below = node.get(key)
        if isinstance(below, dict):
            self._descend(below, level, entries)
            return
        if below is None:
            below = node[key] = Container(level)
        self.held += below.add(entries)
        if below.size > BURST and level < 8:
            node[key] = {}
            self.held -= below.size
            self._descend(node[key], level, below.settled)

    @staticmethod
    def _containers(node) -> Iterator[Container]:
        if isinstance(node, Container):
            yield node
        else:
            for below in node.values():
                yield from HatTrie._containers(below)

    def spill(self, keep: int) -> tuple | None:
        """The entries of the largest subtrees of the root, so that ``keep`` entries at most are left."""
        sizes = {}
        for key, below in self.root.items():
            for container in self._containers(below):
                self.held += container.settle()
                sizes[key] = sizes.get(key, 0) + container.size
        taken = []
        for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
            if self.held <= keep:
                break
            taken += [c.settled for c in self._containers(self.root.pop(key)) if c.size]
            self.held -= sizes[key]
        return tuple(map(np.concatenate, zip(*taken))) if taken else None


class Filter:
    """Which ids may be frequent: a bitmap of fixed size."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask, whole = np.uint64((1 << bits) - 1), np.zeros((1 << bits) // 8, np.uint8)
        step = (1 << BLOCK_BITS) // 8
        for block, data in blocks.items():
            whole[block * step : (block + 1) * step] = np.frombuffer(data, np.uint8)
        self.bitmap = whole

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = ids & self.mask
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def lang_id(lang: str, seed: int) -> int:
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(word_hashes(data, np.zeros(1, np.int64), np.array([len(data)]), seed + 1)[0])


class Words:
    """The words of a slice of rows: where they stand, their ids, and whether the next one is in the same piece."""

    def __init__(self, texts: pa.Array, langs: list[str], seed: int, ids_of_langs: dict[str, int]):
        self.seed = seed
        self.data, begins, ends = text_bytes(texts)
        self.data = lower_ascii(self.data)
        kind = _KIND[self.data]
        self.starts, self.stops, owner = spans(kind == 0, begins, ends)
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.joined = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
        for lang in set(langs) - ids_of_langs.keys():
            ids_of_langs[lang] = lang_id(lang, seed)
        self.lang = np.array([ids_of_langs[x] for x in langs], np.uint64)[owner]
        self.ids = word_hashes(self.data, self.starts, self.stops, seed)


def _top(ids: np.ndarray, place: int) -> np.ndarray:
    """The first two bytes of an id, as the place-th word of a path."""
    return (ids >> np.uint64(48)) << np.uint64(48 - 16 * place)


def frequent_pairs(words: Words, filters: dict[int, Filter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, id of the first word, id of the pair) of neighbours in a piece that may both be frequent."""
    one = mix(words.lang, words.ids)
    able = filters[1](one)
    at = np.flatnonzero(words.joined & able[:-1] & able[1:])
    return at, one[at], mix(one[at], words.ids[at + 1])


def phrases(words: Words, longest: int, filters: dict[int, Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, path, parent, word) of all words, with a second hash in place of the path; or, given filters, of all
    longer phrases whose pairs may be frequent."""
    if not filters:
        yield 1, word_hashes(words.data, words.starts, words.stops, words.seed + (1 << 32)), words.lang, words.ids
        return
    at, one, own = frequent_pairs(words, filters)
    good = filters[2](own)
    at, one, own = at[good], one[good], own[good]
    chain = np.zeros(len(words.ids) + longest, bool)
    chain[at] = True
    path = _top(one, 0) | _top(own, 1)
    yield 2, path, one, words.ids[at + 1]
    for size in range(3, longest + 1):
        on = chain[at + size - 2]  # the pair that the next word makes
        at, parent, path = at[on], own[on], path[on]
        word = words.ids[at + size - 1]
        own = mix(parent, word)
        path = path | _top(own, size - 1) if size <= 4 else path
        yield size, path, parent, word


def _sent(length: int, entries: tuple, parts: int) -> Iterator[pa.RecordBatch]:
    """Entries as sorted runs, one for each prefix partition that has any; words go with their second hash."""
    path, parent, word, count = entries
    part = mix(np.full(len(path), length, np.uint64), mix(parent, word) if length == 1 else path) % np.uint64(parts)
    order = np.lexsort((word, parent, part))
    part = part[order]
    sent = [parent[order], word[order], count[order].astype("<i8"), path[order] if length == 1 else path[:0]]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    bounds = np.append(begin, len(part)).tolist()
    rows = list(zip(bounds, bounds[1:]))
    yield pa.record_batch(
        [
            pa.array(part[begin].astype(np.int64)),
            pa.array([length] * len(rows), pa.int32()),
            *(pa.array([x[a:b].tobytes() for a, b in rows], pa.binary()) for x in sent),
        ],
        names=["part", "length", "parents", "words", "counts", "checks"],
    )


RUNS = "part bigint, length int, parents binary, words binary, counts binary, checks binary"


def local_counts(docs: DataFrame, longest: int, filters: Kept | None, parts: int, seed: int) -> DataFrame:
    """Sorted runs of the phrases that every task counts in its trie."""

    def run(batches):
        tries, known = {}, {}
        ready = filters.get() if filters else {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for a, b in byte_spans(texts, SLICE_BYTES):
                words = Words(texts.slice(a, b - a), langs[a:b], seed, known)
                for length, path, parent, word in phrases(words, longest, ready):
                    tries.setdefault(length, HatTrie()).add(path, parent, word)
                if sum(t.held for t in tries.values()) > HELD:
                    length = max(tries, key=lambda k: tries[k].held)
                    if (out := tries[length].spill(tries[length].held // 2)) is not None:
                        yield from _sent(length, out, parts)
        for length, trie in tries.items():
            if (out := trie.spill(0)) is not None:
                yield from _sent(length, out, parts)

    return docs.mapInArrow(run, RUNS)


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(length, parent, word, f, id) of the phrases with f of ``least`` or more, id being theirs as the first part of longer ones;
    with length 0, the number of words of each lang; with length -1, frequent ids that two words share."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        length = group["length"][0].as_py()
        parent, word, check = (np.frombuffer(b"".join(group[c].to_pylist()), np.uint64) for c in ("parents", "words", "checks"))
        count = np.frombuffer(b"".join(group["counts"].to_pylist()), np.int64)
        check, parent, word, count = counted(check if length == 1 else parent, parent, word, count)
        lengths = np.full(len(count), length, np.int32)
        keep = count >= least
        if length == 1:
            same = np.append(False, (parent[1:] == parent[:-1]) & (word[1:] == word[:-1]))
            keep |= same
            lengths[same] = -1
            langs, code = np.unique(parent, return_inverse=True)
            sums = np.zeros(len(langs), np.int64)
            np.add.at(sums, code, count)
            keep = np.append(keep, np.ones(len(langs), bool))
            lengths, parent, word = np.append(lengths, np.zeros(len(langs), np.int32)), np.append(parent, langs), np.append(word, langs)
            count = np.append(count, sums)
        columns = (lengths, parent.view(np.int64), word.view(np.int64), count, mix(parent, word).view(np.int64))
        return pa.table([pa.array(x[keep]) for x in columns], names=["length", "parent", "word", "f", "id"])

    return runs.groupBy("part", "length").applyInArrow(merge, "length int, parent bigint, word bigint, f bigint, id bigint")


def pair_filter(docs: DataFrame, filters: Kept, least: int, seed: int) -> Filter:
    """A bitmap of the hash buckets into which pairs of frequent words fall ``least`` times or more.

    A task counts no further than ``least``. Its counts go by block of buckets to the tasks that add them up.
    """
    bits, step = BITMAP_BITS[2], 1 << BLOCK_BITS
    kind = np.min_scalar_type(least)

    def count(batches):
        counts, known = np.zeros(1 << bits, kind), {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for a, b in byte_spans(texts, SLICE_BYTES):
                words = Words(texts.slice(a, b - a), langs[a:b], seed, known)
                _, _, pairs = frequent_pairs(words, filters.get())
                bucket, times = np.unique(pairs & np.uint64((1 << bits) - 1), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + times, least)
        used = np.flatnonzero(counts)
        for block, at in ((int(x[0]) // step, x) for x in np.split(used, np.flatnonzero(np.diff(used // step)) + 1) if len(x)):
            columns = [pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in ((at % step).astype("<u4"), counts[at]))]
            yield pa.record_batch(columns, names=["block", "places", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(block, np.zeros(step, np.int64))
                total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, kind)
        for block, total in totals.items():
            marks = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([marks], pa.binary())], names=["block", "data"])

    local = docs.mapInArrow(count, "block int, places binary, counts binary")
    rows = local.repartition("block").mapInArrow(add, "block int, data binary").collect()
    return Filter(bits, {r["block"]: bytes(r["data"]) for r in rows})


def bitmap(ids: DataFrame, bits: int) -> Filter:
    """A bitmap of ids; its blocks are made by tasks, and no more than its bits come to the driver."""
    step = 1 << BLOCK_BITS

    def block(group: pa.Table) -> pa.Table:
        marks = np.zeros(step, np.uint8)
        marks[group["bit"].to_numpy()] = 1
        return pa.table({"block": group["block"][:1], "data": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    place = F.col("id").bitwiseAND((1 << bits) - 1)
    bits_set = ids.select(F.floor(place / step).cast("int").alias("block"), (place % step).cast("int").alias("bit")).distinct()
    return Filter(bits, {r["block"]: bytes(r["data"]) for r in bits_set.groupBy("block").applyInArrow(block, "block int, data binary").collect()})


def word_texts(docs: DataFrame, wanted: Kept, seed: int) -> DataFrame:
    """(word, text) of the words in a filter, once a task."""

    def run(batches):
        seen, known = np.zeros(0, np.uint64), {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for a, b in byte_spans(texts, SLICE_BYTES):
                words = Words(texts.slice(a, b - a), langs[a:b], seed, known)
                at = np.flatnonzero(wanted.get()(words.ids))
                ids, first = np.unique(words.ids[at], return_index=True)
                new = ~np.isin(ids, seen, assume_unique=True)
                ids, first = ids[new], at[first[new]]
                seen = np.concatenate([seen, ids])
                if len(ids):
                    found = [words.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(words.starts[first], words.stops[first])]
                    yield pa.record_batch([pa.array(ids.view(np.int64)), pa.array(found)], names=["word", "text"])

    return docs.mapInArrow(run, "word bigint, text string")


def lang_names(docs: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(names), pa.array([lang_id(x, seed) - (1 << 64) * (lang_id(x, seed) >> 63) for x in names], pa.int64())], names=["lang", "root"])

    return docs.select("lang").distinct().mapInArrow(run, "lang string, root bigint")


def frequent(docs: DataFrame, longest: int, least: int, seed: int) -> DataFrame:
    """(length, parent, word, f, id) of all frequent phrases of up to ``longest`` words, and the other rows of ``merged``."""
    spark = docs.sparkSession
    kept = lambda value: Kept(spark, value, lambda x: x)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (6 * PART_WORDS)
    counts = written(merged(local_counts(docs, 1, None, parts, seed), least), "word-counts")
    filters = {1: bitmap(counts.filter("length = 1").select("id"), BITMAP_BITS[1])}
    filters[2] = pair_filter(docs, kept(filters), least, seed)
    longer = written(merged(local_counts(docs, longest, kept(filters), parts, seed), least), "phrase-counts")
    return counts.unionByName(longer)


def ambiguous(counts: DataFrame, langs: DataFrame) -> bool:
    """Whether two langs, words or frequent phrases have one id."""
    ids = counts.filter("length > 0").groupBy("id").count().filter("count > 1").select("id")
    roots = langs.groupBy("root").count().filter("count > 1").select("root")
    return not counts.filter("length < 0").select("id").union(ids).union(roots).isEmpty()


def _cuts(spelled: DataFrame) -> DataFrame:
    """(id, cut, left, right) of every cut of a phrase (id, root, words), by the ids of its two parts."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch["words"]).to_numpy()
            root = batch["root"].to_numpy().view(np.uint64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                words = batch["words"].take(pa.array(rows)).flatten().to_numpy().view(np.uint64).reshape(-1, size)
                for cut in range(1, size):
                    left, right = root[rows], root[rows]
                    for k in range(cut):
                        left = mix(left, words[:, k])
                    for k in range(cut, size):
                        right = mix(right, words[:, k])
                    yield pa.record_batch(
                        [batch["id"].take(pa.array(rows)), pa.array(np.full(len(rows), cut, np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))],
                        names=["id", "cut", "left", "right"],
                    )

    return spelled.select("id", "root", "words").mapInArrow(run, "id bigint, cut int, left bigint, right bigint")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first phrases by score, of docs (text, lang)."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    seed = 0
    while True:
        counts = frequent(docs, longest, least, seed)
        langs = written(lang_names(docs, seed), "langs")
        if not ambiguous(counts, langs):
            break
        seed += 2
    spelled = counts.filter("length = 1").select("id", F.col("parent").alias("root"), F.array("word").alias("words"))
    all_spelled = None
    for length in range(2, longest + 1):
        above = spelled.withColumnRenamed("id", "parent")
        spelled = counts.filter(F.col("length") == length).join(above, "parent").select(
            "id", "root", F.concat("words", F.array("word")).alias("words"), "parent", "f"
        )
        all_spelled = spelled if all_spelled is None else all_spelled.unionByName(spelled)
        spelled = spelled.select("id", "root", "words")
    spelled = written(all_spelled, "phrases")
    cuts = written(_cuts(spelled), "cuts")

    known = counts.filter("length > 0").select("id", "f")
    suffix = cuts.filter("cut = 1").join(spelled.select("id", F.col("f").alias("f_long")), "id").select(F.col("right").alias("part"), "f_long")
    longer = suffix.union(spelled.select("parent", "f")).groupBy("part").agg(F.max("f_long").alias("f_long"))
    inside = longer.join(known.withColumnRenamed("id", "part"), "part").filter("f_long >= f").select(F.col("part").alias("id"))
    left = spelled.join(inside, "id", "left_anti")

    exact = lambda c: F.col(c).cast(DecimalType(19, 0))
    parts = cuts.join(left.select("id", "root", F.col("f").alias("a")), "id")
    parts = parts.join(known.select(F.col("id").alias("left"), F.col("f").alias("l")), "left")
    parts = parts.join(known.select(F.col("id").alias("right"), F.col("f").alias("r")), "right")
    totals = counts.filter("length = 0").groupBy(F.col("word").alias("root")).agg(F.sum("f").alias("n"))
    parts = parts.join(totals, "root")
    thousand = F.lit(1000).cast(DecimalType(4, 0))
    whole = parts.select("id", "root", "a", "l", "r", "n", "cut", (exact("a") * exact("n")).alias("above"), (exact("l") * exact("r")).alias("below"))
    scored = whole.withColumn("score", F.expr("CAST((above * CAST(1000 AS DECIMAL(4,0))) DIV below AS BIGINT)"))
    best = scored.groupBy("id").agg(F.min(F.struct("score", "cut", "root", "a", "l", "r", "n")).alias("best")).select("id", "best.*")
    by_score = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("a"))
    top = written(best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= first).drop("place", "cut"), "top")

    letters = written(top.join(spelled.select("id", "words"), "id").select("id", F.posexplode("words").alias("place", "word")), "words")
    wanted = Kept(docs.sparkSession, bitmap(letters.select(F.col("word").alias("id")), BITMAP_BITS[1]), lambda value: value)
    letters = letters.join(word_texts(docs, wanted, seed).distinct(), "word")
    phrase = letters.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    named = top.join(phrase, "id").join(langs, "root")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.select("lang", rank.cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked.filter(F.col("rank") <= first)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
held AS (
  SELECT lang, phrase[:length(phrase) - length(split_part(phrase, ' ', k::INT)) - 1] AS phrase, f FROM c
  UNION ALL SELECT lang, phrase[length(split_part(phrase, ' ', 1)) + 2:] AS phrase, f FROM c),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.phrase = c.phrase AND h.f >= c.f)),
cuts AS (
  SELECT lang, k, phrase, f, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS one, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS two
  FROM kept, range(1, 5) t(j) WHERE j < k),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n.n AS n, j,
    ((1000::HUGEINT * cuts.f * n.n) // (x.f::HUGEINT * y.f)) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = two JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
