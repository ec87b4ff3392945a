"""Collocations against a plain count, and the trie on its own."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pulselake.llm import collocations


def brute(rows, longest, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    long = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = set()
    for (lang, words), a in long.items():
        dropped |= {(lang, part) for part in (words[1:], words[:-1]) if a >= f[lang, part]}
    out = {}
    for (lang, words), a in long.items():
        if (lang, words) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1)
    )


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, score int")


def result(frame, **options):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in collocations.collocations(frame, **options).select(*columns).collect())


@pytest.mark.parametrize(("held", "burst"), [(3_000_000, 65_536), (300, 40)])
def test_against_brute_force(spark, monkeypatch, held, burst):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 5000)
    monkeypatch.setattr(collocations, "PART_WORDS", 2000)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Été", "a" * 300, "no break", "x\x0by", "q\x00z"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(300):
        text = "".join(w + rng.choice([" ", " ", "\t ", " ", ". ", "\n"]) for w in rng.choices(words, weights, k=rng.randrange(120)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", "Always the same five words here")] * 30 + [("fr", None), (None, ""), ("fr", " . "), ("fr", "lone")]
    assert result(table(spark, rows).repartition(5), least=6, first=50) == brute(rows, 5, 6, 50)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", {1: 14, 2: 14})
    monkeypatch.setattr(collocations.Filter, "__call__", lambda self, ids: np.ones(len(ids), bool))
    rows = [("en", "a b c d e f")] * 4 + [("en", "a b x d e")] * 3
    assert result(table(spark, rows), least=3) == brute(rows, 5, 3, 2000)


def test_words_of_equal_id_take_another_seed(spark, monkeypatch):
    one = lambda seed, check: np.array([(7, 5, 11, 4, check), (7, 5, 12, 3, check + 1)])
    runs = [(0, 1, *(column.astype(np.int64).tobytes() for column in rows.T[1:])) for rows in (one(0, 1), one(0, 1), one(0, 9))]
    frame = spark.createDataFrame(runs, "part bigint, length int, parents binary, words binary, counts binary, checks binary")
    langs = spark.createDataFrame([("en", 5)], "lang string, root bigint")
    assert not collocations.ambiguous(collocations.merged(frame.limit(2), 3), langs)
    assert collocations.ambiguous(collocations.merged(frame, 3), langs)
    assert collocations.ambiguous(collocations.merged(frame.limit(2), 3), langs.union(langs))
    seeds = []
    plain = collocations.ambiguous
    monkeypatch.setattr(collocations, "ambiguous", lambda counts, langs: plain(counts, langs) or not seeds.append(1) and len(seeds) < 2)
    rows = [("en", "ab ac"), ("en", "ac ab")] * 5
    assert result(table(spark, rows), least=2) == brute(rows, 5, 2, 2000) and len(seeds) == 2


def test_long_text_and_empty_table(spark):
    rows = [("en", "one two three, " * 30_000)]
    assert result(table(spark, rows)) == brute(rows, 5, 100, 2000)
    assert result(table(spark, rows).limit(0)) == []


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, total, spilled = collocations.HatTrie(), Counter(), Counter()
    for _ in range(40):
        path = rng.integers(0, 3, 20_000).astype(np.uint64) << np.uint64(56) | rng.integers(0, 200, 20_000).astype(np.uint64) << np.uint64(48)
        parent, word = path >> np.uint64(8), rng.integers(0, 2000, 20_000).astype(np.uint64)
        trie.add(path, parent, word)
        total.update(zip(parent.tolist(), word.tolist()))
        if trie.held > 250_000:
            before = set(trie.root)
            out = trie.spill(100_000)
            assert trie.held <= 100_000
            gone = before - set(trie.root)
            assert {int(p) >> 56 for p in out[0]} == gone
            for p, w, c in zip(*(x.tolist() for x in out[1:])):
                spilled[p, w] += c
    assert any(isinstance(x, dict) for x in trie.root.values())
    rest = trie.spill(0)
    for p, w, c in zip(*(x.tolist() for x in rest[1:])):
        spilled[p, w] += c
    assert spilled == total and trie.held == 0
