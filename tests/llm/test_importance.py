"""Importance resampling against a plain computation, and the ranking on its own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulselake.llm import importance
from pulselake.llm.queries import QUERIES


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def brute(docs, target, share=25):
    s, t = Counter(), Counter()
    found = [(i, *plain_features(text)) for i, text in docs]
    for _, features, _ in found:
        s.update(features)
    for text in target:
        t.update(plain_features(text)[0])
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s_all + 10000)) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, able = {}, []
    for i, features, n_words in found:
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(features), weight, score)
        if n_words >= 20:
            able.append((-score, i))
    ranks = {i: k for k, (_, i) in enumerate(sorted(able)[: share * len(able) // 100], 1)}
    return sorted((i, *v, ranks.get(i)) for i, v in out.items())


def test_features_of_odd_texts():
    rng = random.Random(3)
    texts = [None, "", "A b", "...", "é x" * 3, "w" * 200 + " q"] + ["".join(rng.choice("abZ  .é0-") for _ in range(rng.randrange(200))) for _ in range(200)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["skipped", *texts])[1:]):
        found, sizes, words = importance.features(column)
        at = 0
        for text, size, count in zip(texts, sizes, words):
            features, n_words = plain_features(text)
            assert found[at : at + size].tolist() == features and count == n_words
            at += size


def test_query(spark, sf, read):
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    wanted = brute(docs, [r.text for r in read("benchmark").collect()])
    got = QUERIES["op12_importance"](spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("rows", [1, 700])
def test_ranks_with_ties_over_many_segments(spark, monkeypatch, rows):
    monkeypatch.setattr(importance, "SEGMENT_ROWS", 12)
    monkeypatch.setattr(importance, "FAN", 4)
    rng = random.Random(rows)
    data = [(i, rng.choice([None, 1, 1, rng.randrange(50)]), 25 - 10 * (i % 7 == 0), rng.choice([5, 5, 5, rng.randrange(-20, 20)])) for i in range(rows)]
    frame = spark.createDataFrame(data, "row bigint, doc_id bigint, n_words bigint, score bigint")
    able = sorted((-s, d is None, d or 0, i) for i, d, n, s in data if n >= 20)
    wanted = {key[3]: k for k, key in enumerate(able[: 60 * len(able) // 100], 1)}
    assert {r.row: r["rank"] for r in importance.ranked(frame, 60).collect()} == wanted


def test_odd_rows(spark, docs):
    long = "one two three " * 8
    frame = docs([None, "", long, long, "short", long], [1, 2, 3, 3, None, None]).withColumn("rank", F.lit("clash"))
    rows = importance.resample(frame, spark.createDataFrame([(None,), ("one two",)], "text string"), 100).collect()
    assert len(rows) == 6 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert [r["weight"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert importance.resample(docs([]).limit(0), frame.limit(0)).collect() == []
