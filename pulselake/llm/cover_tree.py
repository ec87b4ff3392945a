"""Exact top-k by inner product with two cover trees searched at once.

Vectors are dealt into cells around pivots and cells into blocks of a bounded number of rows, so a block is a ball. A block
holds a cover tree of its vectors and one of the queries among them. A node is a centre, one of its vectors, with the
radius that covers all below it. Its children are centres taken farthest first, the node's own before others, until half
its radius covers all rows or there are ``CHILDREN`` of them; each row goes to the nearest. So children lie apart by at least
what covers the rows, whatever that scale is: with clusters a level halves the radius, without them it shrinks as far
as so many children can make it. Nodes of few rows, or of copies of one vector, are leaves. For a query node with centre q and
radius a and a data node with centre p and radius b no score exceeds <q, p> + a|p| + b|q| + ab; the pair is pruned if that is
below the worst k-th score of the queries below the query node. The others are split on the larger side; a leaf of queries
meets those leaves of a data node that are left in one matrix product.

Queries meet the block they come from first. Its results bound what is left: a block of queries is sent to another
block only if the bound of the two roots reaches its worst k-th score. There a portion of all queries, of bounded size, meets
the block's tree, so that the block is sent once for many blocks of queries. Scores are integers, and a bound carries a margin for
rounding, so results are exact; of equal scores the smaller id comes first.

Vectors that are null, empty or hold a null or a non-finite component take no part, nor do rows with a null id. All vectors must
have one length. Rows that repeat an id are separate candidates, except that no row is its own query's candidate by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import Kept, table, written

BLOCK_ROWS = 8192
CELL_ROWS = 4096
MAX_PIVOTS = 4096
# Rows of a leaf, of data and of queries, and children of a node.
DATA_LEAF, QUERY_LEAF = 48, 16
CHILDREN = 16
# Queries that meet a block in one task, on average.
PORTION_QUERIES = 16_384
NOTHING = -(1 << 62)
SUMMARY_ROWS = 200_000


class CoverTree:
    """Rows in tree order, and nodes: centre (a row), radius, range of rows below, first child and number of children."""

    def __init__(self, rows: np.ndarray, nodes: np.ndarray):
        self.rows, self.nodes = rows, nodes
        at, self.radius = nodes[:, 0].astype(np.int64), nodes[:, 1]
        self.begin, self.end, self.child, self.children = nodes[:, 2:].T.astype(np.int64)
        self.centre = rows[at]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def grow(points: np.ndarray, leaf: int = DATA_LEAF, most: int = CHILDREN) -> tuple[CoverTree, np.ndarray]:
    """The tree of the points, and the order of its rows."""
    order, nodes = np.arange(len(points)), []
    square = (points**2).sum(axis=1)

    def distances(rows: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows] + square[at] - 2 * (points[rows] @ points[at]), 0))

    if len(points):
        first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        nodes.append([first, float(distances(order, first).max()), 0, len(points), 0, 0])
    stack = [0] if nodes else []
    while stack:
        me = stack.pop()
        at, reach, lo, hi = nodes[me][:4]
        if hi - lo <= leaf or reach == 0:
            continue
        rows = order[lo:hi].copy()
        centres, nearest, away = [at], np.zeros(len(rows), np.int64), distances(rows, at)
        while len(centres) < most and away.max() > reach / 2:
            at = int(rows[away.argmax()])  # the next centre is the row farthest from all centres
            there = distances(rows, at)
            there[rows == at] = 0
            closer = there < away
            nearest[closer], away[closer] = len(centres), there[closer]
            centres.append(at)
        nodes[me][4:] = len(nodes), len(centres)
        for i, at in enumerate(centres):
            mine = nearest == i
            own = rows[mine]
            order[lo : lo + len(own)] = own
            stack.append(len(nodes))
            nodes.append([at, float(away[mine].max()), lo, lo + len(own), 0, 0])
            lo += len(own)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    table = np.array(nodes, np.float64).reshape(-1, 6)
    table[:, 0] = place[table[:, 0].astype(np.int64)]
    return CoverTree(points[order], table), order


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products: in doubles where these are exact."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**52:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


class Best:
    """The k best (score, id) of each query, kept by score and then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), NOTHING)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x candidates."""
        k = self.scores.shape[1]
        reaching = (scores >= self.scores[rows, -1:]).any(axis=0)  # for some query not below its k-th score
        if not reaching.any():
            return
        scores, ids = scores[:, reaching], ids[reaching]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        if all_scores.shape[1] > 4 * k:  # what is below the k-th score goes first
            worst = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1 : k]
            width = int((all_scores >= worst).sum(axis=1).max())
            at = np.argsort(all_scores < worst, axis=1, kind="stable")[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, at, 1), np.take_along_axis(all_ids, at, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def worst(self) -> np.ndarray:
        return self.scores[:, -1]


def _margin(a, b):
    """More than rounding can take off a bound."""
    return 1e-3 + 1e-9 * a * b


def _bound(q: CoverTree, a: np.ndarray, p: CoverTree, b: np.ndarray) -> np.ndarray:
    centres = np.einsum("ij,ij->i", q.centre[a], p.centre[b])
    return (centres + q.radius[a] * p.norm[b] + p.radius[b] * q.norm[a] + q.radius[a] * p.radius[b]) + _margin(q.norm[a] + q.radius[a], p.norm[b] + p.radius[b])


def search(q: CoverTree, query_ids: np.ndarray, p: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Offer ``best`` every candidate that can be among the k; rows of ``best`` are those of the query tree's order.

    ``query_ids`` and ``ids`` are in the order of the trees' rows. Returns how many scores were computed.
    """
    if not len(q.rows) or not len(p.rows):
        return 0
    computed = 0
    stack = [(0, 0, float("inf"))]

    def meet(own: slice, nodes: np.ndarray) -> int:
        """All scores of a query leaf's rows with those of data leaves."""
        other = np.concatenate([np.arange(p.begin[b], p.end[b]) for b in nodes.tolist()])
        scores = products(q.rows[own], p.rows[other])
        size = scores.size
        scores[query_ids[own, None] == ids[None, other]] = NOTHING
        best.offer(np.arange(own.start, own.stop), scores, ids[other])
        return size

    while stack:
        a, b, bound = stack.pop()
        own = slice(q.begin[a], q.end[a])
        if bound < best.scores[own, -1].min():
            continue
        if not q.children[a] and not p.children[b]:
            computed += meet(own, np.array([b]))
            continue
        split_query = q.children[a] and (not p.children[b] or q.radius[a] >= p.radius[b])
        first, count = (q.child[a], q.children[a]) if split_query else (p.child[b], p.children[b])
        kids = np.arange(first, first + count)
        one, two = (kids, np.full(count, b)) if split_query else (np.full(count, a), kids)
        bounds = _bound(q, one, p, two)
        if not q.children[a]:
            leaves = p.children[kids] == 0
            left = kids[leaves & (bounds >= best.scores[own, -1].min())]
            if len(left):
                computed += meet(own, left)
            one, two, bounds = one[~leaves], two[~leaves], bounds[~leaves]
        for i in np.argsort(bounds, kind="stable"):  # the most promising pair is taken next
            stack.append((int(one[i]), int(two[i]), float(bounds[i])))
    return computed


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    return np.unique(np.array([r.vector for r in sample], np.float64), axis=0)


def blocks(rows: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, vector, is_query, block): blocks are cells of the nearest pivot, large cells cut by hash of the id."""
    centres = _pivots(rows, min(MAX_PIVOTS, -(-rows.count() // cell_rows)))
    kept = Kept(rows.sparkSession, centres, lambda x: x)

    def nearest(batches):
        centres = kept.get()
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            points = _matrix(batch["vector"], centres.shape[1])
            cell = (half - points @ centres.T).argmin(axis=1) if len(points) else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    celled = written(rows.mapInArrow(nearest, "id bigint, vector array<bigint>, is_query boolean, cell bigint"), "cells")
    counts = celled.groupBy("cell").count()  # a row for each pivot
    cut = celled.join(F.broadcast(counts), "cell").withColumn("cuts", F.ceil(F.col("count") / block_rows))
    return cut.select("id", "vector", "is_query", F.struct("cell", F.pmod(F.xxhash64("id"), F.col("cuts")).alias("cut")).alias("block"))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, vector array<bigint>, is_query)."""
    first = rows.select(F.size("vector").alias("n")).first()
    size = first.n if first else 0
    out = "query_id bigint, vec_id bigint, score bigint"
    if not size:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def found(best: Best, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = best.ids < np.iinfo(np.int64).max
        real &= best.scores > NOTHING
        return np.repeat(query_ids, real.sum(axis=1)), best.ids[real], best.scores[real]

    def own_block(group: pa.Table) -> pa.Table:
        """Search a block's queries in the block; keep the block with centre, radius and the worst bound of its queries."""
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        points = _matrix(group["vector"].chunk(0), size)
        tree, order = grow(points)
        asked = group["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        queries, query_order = grow(points[asked], QUERY_LEAF)
        query_ids, ids = ids[asked][query_order], ids[order]
        best = Best(len(query_ids), k)
        search(queries, query_ids, tree, ids, best)
        q, v, s = found(best, query_ids)
        worst = best.worst()
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel().astype(np.int64)))
        nodes = lambda values: pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))
        return pa.table({
            "block": pa.array([group["block"][0].as_py()], group["block"].type),
            "nodes": nodes(tree.nodes), "query_nodes": nodes(queries.nodes),
            "ids": whole(ids), "vectors": whole(tree.rows), "query_ids": whole(query_ids), "queries": whole(queries.rows),
            "worst": whole(worst), "found_query": whole(q), "found_id": whole(v), "found_score": whole(s),
            "centre": whole(tree.centre[0]), "query_centre": whole(queries.centre[:1]),
            "radius": pa.array([float(tree.radius[0])]), "query_radius": pa.array([float(queries.radius[:1].sum())]),
        })

    lists = ["ids", "vectors", "query_ids", "queries", "worst", "found_query", "found_id", "found_score", "centre", "query_centre"]
    schema = "block struct<cell: bigint, cut: bigint>, nodes array<double>, query_nodes array<double>, "
    schema += ", ".join(f"{c} array<bigint>" for c in lists) + ", radius double, query_radius double"
    index = written(blocks(rows).groupBy("block").applyInArrow(own_block, schema), "cover-trees")
    asking = index.filter(F.size("query_ids") > 0).select(
        F.col("block").alias("home"), "query_ids", "queries", "query_nodes", "worst", "query_centre", "query_radius", F.array_min("worst").alias("least")
    )
    # Which blocks can hold something better: roots only. Both sides have a row for each block.
    roots = index.select(F.col("block").alias("target"), F.col("centre").alias("p"), F.col("radius").alias("b"))
    targets = _reach(asking.select("home", "query_centre", "query_radius", "least"), roots)
    # A portion of the homes meets a block's tree in one task: homes are spread by hash over portions of bounded size.
    queries = asking.agg(F.sum(F.size("query_ids"))).first()[0] or 0
    portion = F.pmod(F.xxhash64("home"), F.lit(-(-queries // PORTION_QUERIES) or 1)).alias("portion")
    pairs = written(targets.select("home", "target", portion), "block-pairs")
    asks = pairs.join(asking.select("home", "query_ids", "queries", "query_nodes", "worst"), "home").drop("home")
    wanted = pairs.select(F.col("target").alias("block"), F.col("portion").alias("part")).distinct()
    trees = wanted.join(index.select("block", "ids", "vectors", "nodes"), "block")

    def other_block(homes: pa.Table, blocks: pa.Table) -> pa.Table:
        """The queries of several blocks, block after block, against one block's tree."""
        get = lambda t, c, i=0: t[c][i].values.to_numpy(zero_copy_only=False)
        part = lambda t, rows, nodes, i=0: CoverTree(get(t, rows, i).reshape(-1, size).astype(np.float64), get(t, nodes, i).reshape(-1, 6))
        got: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        if homes.num_rows and blocks.num_rows:
            tree, ids = part(blocks, "vectors", "nodes"), get(blocks, "ids")
            for i in range(homes.num_rows):
                query_ids, floor = get(homes, "query_ids", i), get(homes, "worst", i)
                best = Best(len(query_ids), k)
                best.scores[:] = floor[:, None]  # placeholders without an id: only what reaches the k-th score of the own block counts
                search(part(homes, "queries", "query_nodes", i), query_ids, tree, ids, best)
                got.append(found(best, query_ids))
        q, v, s = (pa.array(np.concatenate(values), pa.int64()) for values in zip(*got))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    there = asks.groupBy("target", "portion").cogroup(trees.groupBy("block", "part")).applyInArrow(other_block, out)
    here = index.select(F.explode(F.arrays_zip("found_query", "found_id", "found_score")).alias("f")).select(
        F.col("f.found_query").alias("query_id"), F.col("f.found_id").alias("vec_id"), F.col("f.found_score").alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return here.unionByName(there).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(asking: DataFrame, roots: DataFrame) -> DataFrame:
    """(home, target): other blocks whose root bound reaches the least k-th score of the home block's queries.

    The roots are broadcast in portions of ``SUMMARY_ROWS``.
    """
    numbered = written(roots.withColumn("portion", F.pmod(F.xxhash64("target"), F.lit(-(-roots.count() // SUMMARY_ROWS) or 1))), "roots")
    parts = []
    for (portion,) in sorted(numbered.select("portion").distinct().collect()):
        got = numbered.filter(F.col("portion") == portion).collect()
        value = (
            [(r.target.cell, r.target.cut) for r in got],
            np.array([r.p for r in got], np.float64),
            np.array([r.b for r in got]),
        )
        kept = Kept(roots.sparkSession, value, lambda x: x)

        def run(batches, kept=kept):
            names, p, b = kept.get()
            norm = np.sqrt((p**2).sum(axis=1))
            kind = pa.struct([("cell", pa.int64()), ("cut", pa.int64())])
            for batch in batches:
                for i in range(batch.num_rows):
                    home = batch["home"][i].as_py()
                    q = np.array(batch["query_centre"][i].as_py(), np.float64)
                    a = batch["query_radius"][i].as_py()
                    bound = p @ q + a * norm + b * np.sqrt((q**2).sum()) + a * b
                    bound += _margin(np.sqrt((q**2).sum()) + a, norm + b)
                    hit = [names[j] for j in np.flatnonzero(bound >= batch["least"][i].as_py()).tolist()]
                    targets = [{"cell": c, "cut": d} for c, d in hit if (c, d) != (home["cell"], home["cut"])]
                    yield pa.record_batch(
                        [pa.array([home] * len(targets), kind), pa.array(targets, kind)], names=["home", "target"]
                    )

        pair = "struct<cell: bigint, cut: bigint>"
        parts.append(asking.mapInArrow(run, f"home {pair}, target {pair}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, vector, is_query is left to the caller): floor(scale * x) of rows that take part."""
    sound = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    return usable.select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"),
    )


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows.withColumn("is_query", F.col("id") % 50 == 0), 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
