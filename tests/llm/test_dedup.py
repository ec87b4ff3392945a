"""Exact duplicates by the tree-merge against a plain grouping."""

import hashlib
import re

import pytest

from pulselake.llm import exact_dedup


def brute(rows):
    groups = {}
    for place, (doc_id, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is None, doc_id or 0, place))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for member in members:
            name = hashlib.sha256(bare.encode()).hexdigest()
            out.append((None if member[1] else member[2], None if best[1] else best[2], len(members), member == best, name))
    return sorted(map(repr, out))


def result(docs):
    return sorted(repr(tuple(r)) for r in exact_dedup.duplicates(docs).collect())


TEXTS = ["a b", "ab", " a\tb\n", None, "", " \r", "é", "é", "AB", "x" * 100_000, "x " * 100_000, "a b", "ab"]


@pytest.mark.parametrize("fan", [2, 16])
def test_merge_over_many_runs(spark, docs, monkeypatch, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    texts = TEXTS + [f"copy {'of a ' * (i % 3)}text" for i in range(60)] + ["hot text"] * 70 + [f"own {i}" for i in range(40)]
    frame = docs(texts).repartition(23)
    rows = list(zip(range(len(texts)), texts))
    assert result(frame) == brute(rows)


def test_repeated_and_null_ids(spark, docs):
    texts, ids = ["a b", "ab", "ab", "c", "c", "d"], [1, 1, 1, None, 5, None]
    got = [tuple(r) for r in exact_dedup.duplicates(docs(texts, ids)).collect()]
    by_text = {}
    for doc_id, keep_id, size, kept, name in got:
        by_text.setdefault(name, []).append((doc_id, keep_id, size, kept))
    groups = sorted(by_text.values(), key=len)
    assert groups[0] == [(None, None, 1, True)]
    assert sorted(groups[1], key=repr) == [(5, 5, 2, True), (None, 5, 2, False)]
    assert [g[:3] for g in groups[2]] == [(1, 1, 3)] * 3 and sum(g[3] for g in groups[2]) == 1


def test_empty_table(docs):
    assert exact_dedup.duplicates(docs([]).limit(0)).collect() == []


def test_no_python_in_the_plan(spark, docs, capsys):
    frame = exact_dedup.duplicates(docs(["a", "a"]))
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())
