"""Byte-level BPE: encoding by numpy merge rounds over many words at once, and decoding.

A tokenizer file of the tokenizers library gives vocabulary, merges and special tokens; the file's path is a
parameter and must exist on every executor. Texts are cut into words by character class with array operations, equal
words of a batch are encoded once, and the ids of a text are gathered from those of its words.

Null and empty texts have no ids. Rows are kept as they come, repeated ids and nulls included; extra columns are
ignored. Memory is bounded by an Arrow batch and the word cache, which is emptied at ``CACHE_WORDS`` words or ``CACHE_BYTES``
bytes of them. A file with a normaliser, another pre-tokenizer or flags of added tokens that change a text is an error.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pulselake.llm.common import code_points, expand, held, slices
from pulselake.llm.words import LONG_WORD, MASKS, eight_bytes, word_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SLICE_CHARS = 1_000_000
CACHE_WORDS = 600_000
CACHE_BYTES = 16_000_000
# The contractions that the pattern of byte-level BPE takes as words.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, after the Unicode properties that the pattern names."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for run in regex.finditer(pattern, every):
            first, last = ord(run[0][0]), ord(run[0][-1])
            table[first : last + 1] = kind
            if first < 0xD800 <= last:
                table[0xD800:0xE000] = OTHER
    return table


def word_starts(points: np.ndarray, section_starts: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of all (non-empty) sections, each of them cut for itself.

    A run of one class is a word, with the space before it. Of several white-space characters before a
    word, all but the last are a word; the last joins the next word if it is a space. An apostrophe at the start of a
    word makes a contraction with the letters after it.
    """
    if not len(points):
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    change = np.empty(len(points), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[section_starts] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(points))
    run_kind = kind[runs]
    opens = np.isin(runs, section_starts, assume_unique=True)  # the run begins a section
    last_of_section = np.append(opens[1:], True)

    space = run_kind == SPACE
    before_word = space & ~last_of_section
    joins = before_word & (points[ends - 1] == 32)
    after_joined = np.append(False, joins[:-1])
    begin = np.zeros(len(points), bool)
    begin[runs[space & ~before_word]] = True
    begin[runs[before_word & (ends - runs > 1)]] = True
    begin[ends[before_word] - 1] = True
    begin[runs[~space & ~after_joined]] = True

    apostrophe = (run_kind == OTHER) & (ends - runs == 1) & (points[runs] == 39) & ~after_joined & ~last_of_section
    at = np.flatnonzero(apostrophe)
    if len(at):
        at = at[run_kind[at + 1] == LETTER]
        quote, letters_end = runs[at], ends[at + 1]
        first = points[quote + 1]
        second = np.where(quote + 2 < letters_end, points[np.minimum(quote + 2, len(points) - 1)], 0)
        taken = np.zeros(len(at), np.int64)
        for text in CONTRACTIONS:
            fits = first == ord(text[1])
            if len(text) == 3:
                fits &= second == ord(text[2])
            taken[fits] = len(text) - 1
        hit = taken > 0
        rest = quote[hit] + 1 + taken[hit]
        begin[quote[hit] + 1] = False
        begin[rest[rest < letters_end[hit]]] = True
    return np.flatnonzero(begin)


def supported(path: str) -> dict:
    """The content of a tokenizer file, if it holds byte-level BPE and nothing that this module doesn't do."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, before = content["model"], content.get("pre_tokenizer") or {}
    odd = [name for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    odd += ["normalizer"] if content.get("normalizer") else []
    odd += ["model type"] if model.get("type", "BPE") != "BPE" else []
    odd += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    odd += [f"{flag} of {t['content']}" for t in content["added_tokens"] for flag in ("lstrip", "rstrip", "single_word") if t.get(flag)]
    if odd:
        raise ValueError(f"no plain byte-level BPE: {', '.join(odd)}")
    return content


class Vocabulary:
    """Ids, bytes and merges of a tokenizer file."""

    def __init__(self, path: str):
        content = supported(path)
        ids = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.byte_of = _byte_of_char()
        size = max([*ids.values(), *self.special.values()]) + 1
        self.base = size
        self.pieces = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(self.byte_of[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        char_of = {b: c for c, b in self.byte_of.items()}
        self.first_ids = np.array([ids[char_of[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in content["model"]["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or one of those from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and how many each word has.

    All symbols lie in one flat array. A round looks up every pair of neighbours of a word by binary
    search over the sorted pair keys, and merges the pair of lowest rank in each word, at all its places from the
    left. Words with no known pair left are set aside.
    """
    unknown = len(v.keys)
    ranks = np.append(v.ranks, unknown)

    def look_up(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * v.base + right
        at = np.searchsorted(v.keys, keys)
        at[at == unknown] = 0
        return np.where(v.keys[at] == keys, at, unknown) if unknown else np.zeros(len(keys), np.int64)

    sizes = np.array([len(w) for w in words], np.int64)
    symbols = v.first_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    # at: where the pair of a symbol and the next one of its word stands among the keys
    at = np.full(len(symbols), unknown)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    at[inner] = look_up(symbols[inner], symbols[inner + 1])
    done_symbols, done_owner = [], []
    while len(symbols):
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(begins, len(symbols)))
        rank = ranks[at]
        lowest = np.minimum.reduceat(rank, begins)
        if (ended := lowest == unknown).any():
            gone = np.repeat(ended, counts)
            done_symbols.append(symbols[gone])
            done_owner.append(owner[gone])
            symbols, owner, at, rank = symbols[~gone], owner[~gone], at[~gone], rank[~gone]
            lowest, counts = lowest[~ended], counts[~ended]
            if not len(symbols):
                break
        places = np.flatnonzero(rank == np.repeat(lowest, counts))
        new_run = np.append(True, np.diff(places) > 1)
        run_start = places[new_run][np.cumsum(new_run) - 1]
        places = places[(places - run_start) % 2 == 0]  # of overlapping equal pairs, every second from the left
        symbols[places] = v.merged[at[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols, owner, at = symbols[keep], owner[keep], at[keep]
        here = places - np.arange(len(places))  # where the new symbols stand now
        changed = np.zeros(len(symbols), bool)
        changed[here] = True
        changed[here[here > 0] - 1] = True
        changed = np.flatnonzero(changed)
        at[changed] = unknown
        changed = changed[changed < len(symbols) - 1]
        changed = changed[owner[changed] == owner[changed + 1]]
        at[changed] = look_up(symbols[changed], symbols[changed + 1])
    symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Ids of texts, with a cache of words. ``encode_words`` gives the ids of words not seen yet.

    Words are looked up by hash, and their bytes compared with those of the cached word; a word becomes a string only when
    it is new. A word whose hash another one has is encoded apart.
    """

    def __init__(self, special: dict[str, int], encode_words):
        self.special, self.encode_words = special, encode_words
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._clear()

    def _clear(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the word of each
        self.ids, self.lengths, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.begins, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.special:
            names = [s.encode() for s in self.special]
            sizes = np.array([len(n) for n in names])
            ends, data = np.cumsum(sizes), np.frombuffer(b"".join(names), np.uint8)
            self._learn(data, ends - sizes, ends, np.array(list(self.special.values())), np.ones(len(names), np.int64))

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray, known: bool = True) -> np.ndarray:
        """Add words; those that are not to be known can be used by their place only."""
        places = len(self.lengths) + np.arange(len(begins))
        if known:
            hashes = word_hashes(data, begins, ends, 0)
            order = np.argsort(hashes)
            at = np.searchsorted(self.hashes, hashes[order])
            self.hashes, self.place = np.insert(self.hashes, at, hashes[order]), np.insert(self.place, at, places[order])
        sizes = ends - begins
        self.begins = np.concatenate([self.begins, len(self.data) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.data = np.concatenate([self.data, data[expand(begins, sizes)]])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return places

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, where words begin and end in them, and how many words each text has."""
        sections, owner, special = [], [], []
        for i, text in enumerate(texts):
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            for k, part in enumerate(parts):
                if part:
                    sections.append(part)
                    owner.append(i)
                    special.append(k % 2 == 1)
        none = np.zeros(0, np.int64)
        if not sections:
            return np.zeros(0, np.uint8), none, none, np.zeros(len(texts), np.int64)
        sizes = np.array([len(s) for s in sections], np.int64)
        begins = np.cumsum(sizes) - sizes
        starts = word_starts(code_points(sections), begins)
        whole = np.array(special)
        of = np.searchsorted(begins, starts, side="right") - 1
        if whole.any():
            keep = ~whole[of] | (starts == begins[of])
            starts, of = starts[keep], of[keep]
        data = np.frombuffer("".join(sections).encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) > sizes.sum():
            starts = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        return data, starts, np.append(starts[1:], len(data)), np.bincount(np.array(owner)[of], minlength=len(texts))

    def _same(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the words are those at the places of the cache, byte by byte."""
        same = sizes == self.sizes[places]
        for i in np.flatnonzero(same & (sizes > LONG_WORD)).tolist():
            a, b, n = begins[i], self.begins[places[i]], sizes[i]
            same[i] = np.array_equal(data[a : a + n], self.data[b : b + n])
        left = np.flatnonzero(same & (sizes <= LONG_WORD))
        mine, cached, at = eight_bytes(data), eight_bytes(self.data), 0
        while len(left):
            mask = MASKS[np.minimum(sizes[left] - at, 8)]
            same[left] = ((mine[begins[left] + at] ^ cached[self.begins[places[left]] + at]) & mask) == 0
            at += 8
            left = left[same[left] & (sizes[left] > at)]
        return same

    def _encode(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, known: bool = True) -> np.ndarray:
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begins.tolist(), ends.tolist())]
        return self._learn(data, begins, ends, *self.encode_words(words), known)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        data, begins, ends, counts = self._words(texts)
        if len(self.lengths) > CACHE_WORDS or len(self.data) > CACHE_BYTES:
            self._clear()
        distinct, first, which = np.unique(word_hashes(data, begins, ends, 0), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        fresh = at == len(self.hashes)
        fresh[~fresh] = self.hashes[at[~fresh]] != distinct[~fresh]
        places = np.zeros(len(distinct), np.int64)
        places[~fresh] = self.place[at[~fresh]]
        if fresh.any():
            new = first[fresh]
            places[fresh] = self._encode(data, begins[new], ends[new])
        places = places[which]
        other = np.flatnonzero(~self._same(data, begins, ends - begins, places))
        if len(other):
            places[other] = self._encode(data, begins[other], ends[other], known=False)
        lengths = self.lengths[places]
        ids = self.ids[expand(self.starts[places], lengths)]
        totals = np.append(0, np.cumsum(lengths))
        stops = np.cumsum(counts)
        return ids, totals[stops] - totals[stops - counts]


def encoder(path: str) -> Encoder:
    def make() -> Encoder:
        v = vocabulary(path)
        return Encoder(v.special, lambda words: merge_rounds([w.encode("utf-8", "surrogatepass") for w in words], v))

    return held(("byte_bpe", path), make)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD. Special tokens appear as their text."""
    return v.flat[expand(v.offsets[ids], v.lengths[ids])].tobytes().decode("utf-8", "replace")


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as array of int) of every row; null or empty text gives an empty array."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                ids, sizes = coder.encode(texts[a:b])
                offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    names=[id_col, "ids"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_table(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; a null array gives a null text. An id outside the vocabulary is an error."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            texts = [decode(x.values.to_numpy(zero_copy_only=False), v) if x.is_valid else None for x in lists]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``encode_table`` and ``decode_table`` give, as digests.

    One pass without a shuffle: ids and decoded text of a slice of rows live only as long as their digests are made.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder, v = encoder(path), vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                ids, sizes = coder.encode(texts[a:b])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                lengths = v.lengths[ids]
                out = v.flat[expand(v.offsets[ids], lengths)].tobytes()
                byte_ends = np.append(0, np.cumsum(lengths))[ends].tolist()
                bounds = [0, *ends.tolist()]
                byte_bounds = [0, *byte_ends]
                n = b - a
                plain = [hashlib.sha256(raw[4 * bounds[i] : 4 * bounds[i + 1]]).hexdigest() for i in range(n)]
                text = [
                    hashlib.sha256(out[byte_bounds[i] : byte_bounds[i + 1]].decode("utf-8", "replace").encode()).hexdigest()
                    for i in range(n)
                ]
                yield pa.record_batch(
                    [batch.column(0).slice(a, n), pa.array(sizes, pa.int64()), pa.array(plain), pa.array(text)],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
