"""Exact search for the largest inner products with cover trees over data and queries.

Vectors are dealt to blocks around pivots (``PIVOTS`` vectors, the first by a hash of their ids). A
block has about ``BLOCK`` rows; a pivot with more has several, so neither a dense region nor one
vector that a third of the rows share makes a large one. Each block becomes a cover tree: a node's
children are centred on members farther apart than the radius that covers them. Equal vectors are one
point with all its ids. Data and queries are indexed alike and written once.

A search goes down a query tree with a list of data nodes. For a query node with centre a and radius
r and a data node with centre b and radius s no product exceeds ``<a, b> + |a| s + |b| r + r s``. Data
nodes whose bound lies below the worst k-th score of the node's queries are dropped; equal bounds
stay, as ties go to the smaller id. Products with the pivots give the first k-th scores. Query trees
go to all blocks in waves of about ``WAVE`` rows, each wave written before the next one is read, so what
the driver holds and broadcasts at a time is bounded; a task keeps k results for each query of the wave.

Products are exact: they can't pass 2^53, as a vector of a norm of 2^26.5 or more is refused in the pass
that reads it. Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id; vectors of other lengths are no candidates of a query. Of rows that share an id the
largest vector counts, compared component by component, so dealing plays no part. Other columns do not
matter. Empty tables give empty results; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.checks import refuse
from tidemark.llm.scratch import stored

PIVOTS, BLOCK, WAVE = 256, 2048, 16_384
LEAF, SHRINK = 24, 1.3
FEW = 512


class Tree(NamedTuple):
    """Points and their ids; per node its centre (a point), covering radius and children or points
    (from ``start`` to before ``end`` of ``order`` or of the nodes); leaves have no children."""

    points: np.ndarray
    ids: np.ndarray
    id_ends: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    order: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """A cover tree, level by level so that a node's children lie side by side."""
    points, of = np.unique(vectors, axis=0, return_inverse=True)
    by_point = np.lexsort((ids, of.ravel()))
    ids = ids[by_point]
    id_ends = np.searchsorted(of.ravel()[by_point], np.arange(len(points)), "right")
    centre, radius, start, end, leaf, order = [0], [0.0], [0], [0], [False], []
    members = [np.arange(len(points))]
    radius[0] = _distances(points, 0, members[0]).max(initial=0.0)
    node = 0
    while node < len(centre):
        own = members[node]
        if len(own) <= LEAF or radius[node] == 0:
            leaf[node], start[node] = True, len(order)
            order += own.tolist()
            end[node] = len(order)
        else:
            start[node], reach, at = len(centre), radius[node] / SHRINK, centre[node]
            while len(own):
                far = _distances(points, at, own)
                near = far <= reach
                near[own == at] = True
                centre.append(int(at))
                radius.append(float(far[near].max()))
                members.append(own[near])
                start.append(0)
                end.append(0)
                leaf.append(False)
                own = own[~near]
                at = own[0] if len(own) else 0
            end[node] = len(centre)
        members[node] = None
        node += 1
    return Tree(points, ids, id_ends, np.array(centre), np.array(radius), np.array(start),
                np.array(end), np.array(leaf), np.array(order, np.int64))


def _distances(points, at, own):
    return np.sqrt(((points[own] - points[at]) ** 2).sum(1))


class Best:
    """The k best rows found so far for each query; ``worst`` is the score that others must reach."""

    def __init__(self, ids: np.ndarray, worst: np.ndarray, k: int):
        self.ids, self.worst, self.k = ids, worst.copy(), k
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty(0), np.empty(0, np.int64)) for _ in ids]

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.rows[query]
        good = ids != self.ids[query]
        scores, ids = np.append(old[0], scores[good]), np.append(old[1], ids[good])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.rows[query] = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.worst[query] = max(self.worst[query], scores[keep[-1]])


def search(queries: Tree, data: Tree, best: Best, shift: int) -> None:
    """Offer to ``best`` what the data tree has for the queries, which stand there from ``shift``."""
    norms = np.sqrt((data.points[data.centre] ** 2).sum(1))
    slack = 1e-9
    query_of = np.arange(len(queries.points))

    def bounds(node, nodes):
        a = queries.points[queries.centre[node]]
        r, s = queries.radius[node], data.radius[nodes]
        exact = data.points[data.centre[nodes]] @ a
        top = exact + np.sqrt(a @ a) * s + norms[nodes] * r + r * s
        return top + slack * (np.abs(top) + 1)

    def own_queries(node):
        if queries.leaf[node]:
            points = queries.order[queries.start[node] : queries.end[node]]
            return np.concatenate([
                np.arange(queries.id_ends[p - 1] if p else 0, queries.id_ends[p]) for p in points])
        return np.concatenate([own_queries(c) for c in range(queries.start[node], queries.end[node])])

    def opened(nodes):
        """Children of inner nodes instead of these."""
        inner = ~data.leaf[nodes]
        parts = [np.arange(data.start[n], data.end[n]) for n in nodes[inner]]
        return np.concatenate([nodes[~inner], *parts])

    def visit(node, nodes):
        rows = own_queries(node) + shift
        while True:
            nodes = nodes[bounds(node, nodes) >= best.worst[rows].min()]
            wide = ~data.leaf[nodes] & (data.radius[nodes] > queries.radius[node])
            if not queries.leaf[node] and not wide.any():
                break
            if queries.leaf[node] and data.leaf[nodes].all():
                break
            split = nodes[wide] if not queries.leaf[node] else nodes
            rest = nodes[~wide] if not queries.leaf[node] else nodes[:0]
            nodes = np.concatenate([rest, opened(split)])
        if not len(nodes):
            return
        if not queries.leaf[node]:
            for child in range(queries.start[node], queries.end[node]):
                visit(child, nodes)
            return
        top = bounds(node, nodes)
        nodes = nodes[np.argsort(-top)]
        top = -np.sort(-top)
        points = queries.order[queries.start[node] : queries.end[node]]
        at = 0
        while at < len(nodes) and top[at] >= best.worst[rows].min():
            sizes = np.cumsum(data.end[nodes[at:]] - data.start[nodes[at:]])
            stop = at + max(1, int(np.searchsorted(sizes, FEW)))
            found = np.concatenate([data.order[data.start[n] : data.end[n]] for n in nodes[at:stop]])
            products = queries.points[points] @ data.points[found].T
            for line, point in enumerate(points):
                low = queries.id_ends[point - 1] if point else 0
                for query in range(low + shift, queries.id_ends[point] + shift):
                    hit = np.flatnonzero(products[line] >= best.worst[query])
                    if len(hit):
                        _offer(best, query, products[line][hit], found[hit], data)
            at = stop

    visit(0, np.array([0]))


def _offer(best: Best, query: int, scores: np.ndarray, points: np.ndarray, data: Tree) -> None:
    """Of a point's ids only the k + 1 smallest can count: one may be the query's own."""
    if len(points) > best.k + 1:
        least = np.partition(scores, len(scores) - best.k - 1)[len(scores) - best.k - 1]
        scores, points = scores[scores >= least], points[scores >= least]
    starts = np.where(points > 0, data.id_ends[points - 1], 0)
    sizes = np.minimum(data.id_ends[points] - starts, best.k + 1)
    ids = np.concatenate([data.ids[a : a + n] for a, n in zip(starts, sizes)])
    best.offer(query, np.repeat(scores, sizes), ids)


def usable(vectors: DataFrame, id_column: str, vector_column: str, scaled: Column) -> DataFrame:
    """(id, v, dim): a row for each id that takes part, with whole numbers as components."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("x"),
    ).where("id IS NOT NULL AND size(x) > 0")
    rows = rows.where(
        "NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    rows = rows.select("id", scaled.alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    problem = F.concat(F.lit("products of vector "), "id", F.lit(" are too large to be exact"))
    return refuse(rows, square >= 2.0**53, problem).select("id", "v", F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _nearest(shared):
    def run(batches):
        pivots = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = [i for i, p in enumerate(pivots) if len(p) == dim]
                if own:
                    x = _matrix(batch.column("v").take(pa.array(rows)), dim)
                    centres = np.array([pivots[i] for i in own])
                    far = (centres ** 2).sum(1) - 2 * x @ centres.T
                    out[rows] = np.array(own)[far.argmin(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out)], names=[*batch.schema.names, "pivot"])

    return run


def _plant(group: pa.Table) -> pa.Table:
    dim = group["dim"][0].as_py()
    vectors = _matrix(group["v"].combine_chunks(), dim)
    tree = build(group["id"].to_numpy(), vectors)
    return pa.table({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(vectors)], pa.int64()),
                     "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def index(rows: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """A row (dim, n, tree) for each block of rows (id, v, dim) around as many of the pivots as there
    are blocks."""
    n_blocks = max(1, -(-rows.count() // BLOCK))
    shared = rows.sparkSession.sparkContext.broadcast(pivots[:n_blocks])
    dealt = rows.mapInArrow(_nearest(shared), "id long, v array<double>, dim int, pivot int")
    dealt = stored(dealt, "dealt")
    sizes = dealt.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("dim", "pivot", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts"))
    blocks = dealt.join(parts, ["dim", "pivot"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = blocks.groupBy("dim", "pivot", "part").applyInArrow(
        _plant, "dim int, n long, tree binary")
    return stored(blocks, "trees")


def _search_blocks(shared, shared_pivots, k: int):
    def run(batches):
        waves, pivots = [pickle.loads(x) for x in shared.value], shared_pivots.value
        if not waves:
            return
        ids = np.concatenate([t.ids for t in waves])
        worst = []
        for tree in waves:
            dim = tree.points.shape[1]
            centres = [(i, p) for i, p in pivots.items() if len(p) == dim]
            vectors = np.repeat(tree.points, np.diff(tree.id_ends, prepend=0), axis=0)
            if len(centres) > k:
                products = vectors @ np.array([p for _, p in centres]).T
                own = np.array([i for i, _ in centres])
                products[tree.ids[:, None] == own[None, :]] = -np.inf
                worst.append(-np.partition(-products, k - 1, axis=1)[:, k - 1])
            else:
                worst.append(np.full(len(vectors), -np.inf))
        best = Best(ids, np.concatenate(worst), k)
        for batch in batches:
            for dumped in batch.column("tree"):
                data, shift = pickle.loads(dumped.as_py()), 0
                for tree in waves:
                    if tree.points.shape[1] == data.points.shape[1]:
                        search(tree, data, best, shift)
                    shift += len(tree.ids)
        counts = [len(x) for _, x in best.rows]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(ids, counts)),
            pa.array(np.concatenate([x for _, x in best.rows])),
            pa.array(np.concatenate([s for s, _ in best.rows]).astype(np.int64)),
        ], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest product for each query, ties to
    the smaller id. Both tables as from ``usable``."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {r["id"]: np.array(r["v"], float) for r in chosen}
    by_id = spark.sparkContext.broadcast(pivots)
    data = index(rows, list(pivots.values()))
    asked = index(queries, list(pivots.values()))
    waves = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // WAVE))
    asked = asked.withColumn("wave", F.pmod(F.xxhash64("tree"), F.lit(waves)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for wave in range(waves):
        trees = [bytes(r[0]) for r in asked.where(F.col("wave") == wave).select("tree").collect()]
        shared = spark.sparkContext.broadcast(trees)
        part = data.select("tree").mapInArrow(
            _search_blocks(shared, by_id, k), "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = stored(part.select("query_id", "rank", "vec_id", "score"), "nearest")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found
