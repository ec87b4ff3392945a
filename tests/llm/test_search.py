"""Joins and searches against SQL and brute force."""

import random

import duckdb
import numpy as np
import pytest

from pulselake.llm import cover_tree, decontamination, graph, jaccard_join, warc
from pulselake.llm.queries import ORACLES, QUERIES


def duck(sf, sql, **frames):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, frame in frames.items():
        con.execute(f"DROP VIEW {name}")
        con.register(name, frame)
    cursor = con.execute(sql)
    return sorted(map(repr, cursor.fetchall())), [c[0] for c in cursor.description]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    wanted, columns = duck(sf, ORACLES[name])
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()) == wanted


def shingles(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, percent):
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("block", "hot", "part"), [(10**6, 16, 10**7), (120, 2, 2000), (10**6, 6, 500)])
def test_jaccard_join_near_copies(docs, monkeypatch, block, hot, part):
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", block)
    monkeypatch.setattr(jaccard_join, "HOT_SETS", hot)
    monkeypatch.setattr(jaccard_join, "BYTES_PER_PART", part)
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 11)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own[: rng.choice([60, 60, 58, 55])]))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(30)) for _ in range(10)] + ["one two", "One\ttwo", "", None, "é É a b c", "é É A b c"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)), 85)


def test_jaccard_join_odd_rows(docs):
    df = docs(["a b c d e", "a b c d e", "a b c d e", "a b c d e"], ids=[None, 7, 7, 3])
    got = sorted(jaccard_join.join_components(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(None, 2, None), (3, 2, 3), (7, 2, 3), (7, 2, 3)]
    assert jaccard_join.join_components(df.limit(0)).count() == 0


def test_jaccard_join_different_texts_under_one_id(docs):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [a, b, a[:15] + b[15:], [*a, "zz"], b, ["lone"]]
    df = docs([" ".join(t) for t in texts], ids=[1, 1, 2, 3, 4, 5])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(df).collect())
    assert got == [(1, 27, 1), (1, 27, 1), (2, 27, 2), (3, 28, 1), (4, 27, 1), (5, 1, 5)]


def test_jaccard_join_query_links_rows_without_id(docs, tmp_path):
    words = [f"w{i}" for i in range(60)]
    left, middle, right = " ".join(words[:50]), " ".join(words[:54]), " ".join(words[4:54])
    df = docs([right, middle, left, "a b", "A b", "c", "", middle], ids=[9, None, 4, None, 7, None, None, 30])
    df.limit(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_jaccard_join"](df.sparkSession, str(tmp_path)).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert found == sorted([(9, 47, 4), (None, 51, 4), (4, 47, 4), (None, 1, 7), (7, 1, 7), (None, 1, None), (None, 0, None)], key=str)


def test_jaccard_join_equal_slices_in_two_tasks(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SETS", 3)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[: 40 - i]) for i in range(6)] + ["some other words that stand alone", "a b"]
    df = docs(texts).coalesce(1).union(docs(texts, range(100, 108)).coalesce(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df).collect()}
    assert got == brute_components([*enumerate(texts), *enumerate(texts, 100)], 85)


def test_jaccard_join_sends_in_proportion(docs):
    """More parts of the hashes do not make more data than a set's name with each n-gram."""
    rng = random.Random(3)
    df = docs([" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(150)]).coalesce(1)
    grams = 150 * 37

    def bytes_of(parts):
        rows = jaccard_join.sent_grams(df.select("doc_id", "text"), 4, parts).collect()
        return sum(sum(len(r[c]) for c in ('slice', 'sets', 'sizes', 'hashes', 'owners', 'marks')) for r in rows)

    assert bytes_of(1) <= grams * 10 + 40 * 150
    assert bytes_of(100_000) <= grams * 26 + 40 * 150


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 3), *((k, k + 1) for k in range(20, 60))]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5} | {k: 20 for k in range(20, 61)}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) == set(want)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    points = rng.integers(-40, 40, (700, 6))
    points[100:400] = points[50]  # a large group of copies
    vectors = [(i, [float(x) / 256 for x in p]) for i, p in enumerate(points)]
    odd = [(1000, None), (1050, []), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] * 6), (None, [0.0] * 6), (1200, [float("inf")] * 6)]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>")
    rows = cover_tree.quantised(df).selectExpr("*", "id % 50 = 0 AS is_query")
    for k in (5, 900):
        got = [tuple(r) for r in cover_tree.top_k(rows, k).orderBy("query_id", "rank").collect()]
        want = []
        for q in range(0, 700, 50):
            ranked = sorted((-int(points[q] @ points[i]), i) for i in range(700) if i != q)[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
        assert got == want
    assert cover_tree.top_k(rows.limit(0), 5).count() == 0


def test_cover_tree_prunes_clusters():
    rng = np.random.default_rng(7)
    points = (np.repeat(rng.normal(0, 400, (30, 8)), 60, axis=0) + rng.normal(0, 3, (1800, 8))).round()
    tree, order = cover_tree.grow(points)
    queries, query_order = cover_tree.grow(points[::90], 4)
    for at, reach, low, high, _, _ in tree.nodes:
        below = tree.rows[int(low) : int(high)]
        assert np.sqrt(((below - tree.rows[int(at)]) ** 2).sum(axis=1)).max() <= reach + 1e-6
    best = cover_tree.Best(20, 3)
    computed = cover_tree.search(queries, np.arange(0, 1800, 90)[query_order], tree, order, best)
    assert computed < 20 * 1800 / 4
    scores = np.sort(queries.rows @ points.T, axis=1)
    own = (queries.rows**2).sum(axis=1)
    assert all((row[row != o][-1] >= b[-1]) for row, o, b in zip(scores, own, best.scores))


def test_cover_tree_reaches_its_leaves_without_clusters():
    rng = np.random.default_rng(8)
    points = (256 * rng.normal(0, 1, (3000, 64)) / 8).round()
    points[500:900] = points[3]
    tree, order = cover_tree.grow(points)
    assert sorted(order.tolist()) == list(range(3000)) and np.array_equal(tree.rows, points[order])
    assert len(tree.nodes) > 60
    for i in range(len(tree.nodes)):
        below = tree.rows[tree.begin[i] : tree.end[i]]
        assert np.sqrt(((below - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        if not tree.children[i]:
            assert len(below) <= cover_tree.DATA_LEAF or tree.radius[i] == 0
            continue
        kids = np.arange(tree.child[i], tree.child[i] + tree.children[i])
        assert tree.begin[kids[0]] == tree.begin[i] and tree.end[kids[-1]] == tree.end[i]
        assert np.array_equal(tree.begin[kids[1:]], tree.end[kids[:-1]])
        apart = np.sqrt(((tree.centre[kids][:, None] - tree.centre[kids]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(kids))
        assert apart.min() >= tree.radius[kids].max() - 1e-6  # centres lie apart by what covers the rows
    queries, query_order = cover_tree.grow(points[::50], cover_tree.QUERY_LEAF)
    best = cover_tree.Best(60, 5)
    cover_tree.search(queries, np.arange(0, 3000, 50)[query_order], tree, order, best)
    for q, scores, ids in zip(np.arange(0, 3000, 50)[query_order].tolist(), best.scores.tolist(), best.ids.tolist()):
        ranked = sorted((-int(points[q] @ points[i]), i) for i in range(3000) if i != q)[:5]
        assert list(zip(scores, ids)) == [(-s, i) for s, i in ranked]


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Portions of a few queries and blocks of a few rows give the same rows."""
    monkeypatch.setattr(cover_tree, "PORTION_QUERIES", 10)
    monkeypatch.setattr(cover_tree.blocks, "__defaults__", (60, 90))
    rng = np.random.default_rng(9)
    points = rng.integers(-300, 300, (600, 5))
    rows = spark.createDataFrame([(i, [int(x) for x in p], i % 7 == 0) for i, p in enumerate(points)], "id bigint, vector array<bigint>, is_query boolean")
    got = [tuple(r) for r in cover_tree.top_k(rows, 4).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 600, 7):
        ranked = sorted((-int(points[q] @ points[i]), i) for i in range(600) if i != q)[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    assert got == want


def test_decontamination_odd_rows(docs, spark):
    item = "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa lambda"
    texts = [None, "", "x " + item.upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "short one", "a short-one b", item + " " + item, "p " * 40000 + item]
    bench = spark.createDataFrame([(2, item, 1), (10, item, 1), (3, "Short one", 1), (4, None, 1), (None, "p p p", 1)], "item_id int, text string, doc_id int")
    for shard in (decontamination.SHARD_BYTES, 60):
        got = {r.doc_id: r for r in decontamination.report(decontamination.match(docs(texts), bench, shard_bytes=shard)).collect()}
        assert [got[i].n_hit for i in range(7)] == [0, 0, 11, 0, 2, 2, 22]
        assert [got[i].n_words for i in range(8)] == [0, 0, 13, 9, 2, 4, 22, 40011]
        assert (got[7].n_hit, got[7].n_items, got[2].n_items, got[6].n_items) == (40011, 3, 2, 2)
        assert [got[i].contaminated for i in range(8)] == [False, False, True, False, True, True, True, True]
    assert decontamination.match(docs(texts).limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.report(decontamination.match(docs(texts), bench.limit(0))).collect())


def test_proximity(docs):
    texts = ["a x b y c", "c b a", "a b", "a x x x x b x c", "c a b c", None]
    got = decontamination.near_matches(docs(texts), {"abc": ["a", "B", "c", "c"], "zz": ["zz", "a"]}, width=5).collect()
    want = set()
    for i, t in enumerate(texts):
        words = (t or "").split()
        want |= {(i, "abc", s) for s in range(len(words)) if words[s] in "abc" and {"a", "b", "c"} <= set(words[s : s + 5])}
    assert {(r.doc_id, r.query, r.start) for r in got} == want


def test_warc_odd_rows(spark):
    pages = [(3, "u\r\nv", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "é" * 300000), (None, "u", "same"), (6, "u", "<p>\r\n\r\nx"), (6, "u", "<p>\r\n\r\nx")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted(map(tuple, warc.read(warc.normalise(warc.write(df))).collect()), key=repr)
    kinds = sorted(((r[0], r[3], r[4], r[1]) for r in got), key=repr)
    want = [
        (3, "revisit", 1, 4), (1, "response", None, 4), (2, "response", None, 0), (4, "revisit", 2, 0), (5, "response", None, 600000),
        (None, "revisit", 1, 4), (6, "response", None, 8), (6, "response", None, 8),
    ]
    assert kinds == sorted(want, key=repr)
    assert {r[2] for r in got if r[1] == 4} == {warc.payload_digest(b"same")}
    alone = warc.write(df, least_bytes=5)
    assert sum(r.record_type == "revisit" for r in warc.read(warc.normalise(alone)).collect()) == 0
    assert warc.read(warc.normalise(warc.write(df.limit(0)))).count() == 0


def test_warc_records_of_any_members():
    import gzip
    import io

    one, two = (warc.record(i, "u", b"x" * 3000000 * i, None, "d") for i in (0, 1))
    for data in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(one[:50]) + gzip.compress(one[50:] + two)):
        assert list(warc.records(io.BytesIO(data))) == [one, two]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(one + two[:-500]))))
