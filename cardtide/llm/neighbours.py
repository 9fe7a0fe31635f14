"""Operator 2, approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most ``SAMPLE`` vectors (smallest hash of their id); every vector is then indexed by
descending to its leaf. A query walks the tree with a priority queue of nodes by distance to their centre and visits
leaves in that order. How many leaves it visits is calibrated: the exact neighbours of ``CALIBRATION`` sampled vectors
among all rows are found in blocks, and the number of visits grows until they are recalled to ``RECALL``.

Vectors and queries meet in cells. A leaf with many vectors or many queries is dealt into several cells, so that a
region that holds a third of all rows is no single task. Distances are computed in double precision on the original
vectors.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE = 8192
BRANCHES = 8
#: Sampled vectors in a leaf at most.
LEAF_SAMPLE = 64
CALIBRATION = 96
RECALL = 0.97
#: Vectors and queries in one cell at most.
CELL_VECTORS, CELL_QUERIES = 4096, 1024
ROUNDS = 8


class Tree(NamedTuple):
    """``children[i]``: node ids below node i, empty for a leaf; ``leaf[i]``: leaf number or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf number of each vector, by the nearest centre on each level."""
        node = np.zeros(len(vectors), np.int64)
        open_ = np.arange(len(vectors))
        while len(open_):
            open_ = open_[self.leaf[node[open_]] < 0]
            order = open_[np.argsort(node[open_], kind="stable")]
            for here in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
                below = self.children[node[here[0]]]
                node[here] = below[_squares(vectors[here], self.centres[below]).argmin(axis=1)]
        return self.leaf[node]

    def visits(self, vector: np.ndarray, count: int) -> list[int]:
        """The first ``count`` leaves, best bin first."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < count:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                continue
            below = self.children[node]
            for distance, child in zip(((self.centres[below] - vector) ** 2).sum(axis=1).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (distance, child))
        return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)


def _split(vectors: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Cluster numbers by Lloyd's rounds from random starts."""
    centres = vectors[random.choice(len(vectors), min(BRANCHES, len(vectors)), replace=False)]
    for _ in range(ROUNDS):
        own = _squares(vectors, centres).argmin(axis=1)
        used = np.unique(own)
        centres = np.stack([vectors[own == k].mean(axis=0) for k in used])
    return _squares(vectors, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, leaf_size: int = LEAF_SAMPLE, seed: int = 7) -> Tree:
    random = np.random.default_rng(seed)
    centres, children, leaf, leaves = [sample.mean(axis=0)], [np.zeros(0, np.int64)], [-1], 0
    queue = [(0, np.arange(len(sample)))]
    while queue:
        node, members = queue.pop(0)
        own = _split(sample[members], random) if len(members) > leaf_size else np.zeros(len(members), np.int64)
        parts = [members[own == k] for k in np.unique(own)]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for part in parts:
            queue.append((len(centres), part))
            centres.append(sample[part].mean(axis=0))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
    return Tree(np.stack(centres), children, np.array(leaf), leaves)


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and have finite components only."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(ids: np.ndarray, vectors: np.ndarray, query: int, vector: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances, nearest first, ties to smaller ids; the query's id is left out, a repeated id counts once."""
    distance = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
    at = np.flatnonzero(ids != query)
    if len(at) > 4 * count:
        border = np.partition(distance[at], 4 * count - 1)[4 * count - 1]
        near = at[distance[at] <= border]
        if len(np.unique(ids[near])) >= count:
            at = near
    at = at[np.lexsort((ids[at], distance[at]))]
    _, first = np.unique(ids[at], return_index=True)
    at = at[np.sort(first)[:count]]
    return ids[at], distance[at]


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)]
    for k, kind in ((1, np.int64), (2, np.float64), (3, np.int32)):
        columns.append(np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.zeros(0, kind))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "leaf"])


def _best(found: DataFrame, count: int) -> DataFrame:
    """The nearest ``count`` of each query; one shuffle, on the query."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min_by(F.struct("score", "leaf"), "score").alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("s.score", "vec_id"))
    return once.select("query_id", rank.cast("int").alias("rank"), "vec_id", "s.score", "s.leaf").where(F.col("rank") <= count)


def _calibrated(rows: DataFrame, tree: Tree, sample: list[tuple[int, np.ndarray]], width: int, count: int, recall: float) -> int:
    """Leaf visits at which the exact neighbours of the calibration vectors are recalled to ``recall`` on average."""
    chosen = sample[:CALIBRATION]

    def block(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            leaf = dict(zip(ids.tolist(), tree.leaf_of(vectors).tolist(), strict=True))
            found = []
            for query, vector in chosen:
                near, distance = _nearest(ids, vectors, query, vector, count)
                found.append((query, near, distance, np.array([leaf[i] for i in near.tolist()])))
            yield _found(found)

    exact: dict[int, list[int]] = {}
    for row in _best(rows.mapInArrow(block, _FOUND), count).collect():
        exact.setdefault(row["query_id"], []).append(row["leaf"])
    needed = []
    for query, vector in chosen:
        place = {leaf: k for k, leaf in enumerate(tree.visits(vector, tree.leaves), 1)}
        needed.append(np.array([place[leaf] for leaf in exact.get(query, [])] or [1]))
    visits = 1
    while visits < tree.leaves and np.mean([(n <= visits).mean() for n in needed]) < recall:
        visits += 1
    return visits


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, count: int = 10, recall: float = RECALL
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest found of every ``every``-th id.

    Vectors that are not ``usable``, have a null id, or another dimension than most rows (the larger one of equally
    frequent ones) take no part. A repeated id is one vector, at its smallest distance, and is never its own neighbour.
    Ties go to the smaller id; with fewer candidates there are fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = common["width"]
    rows = rows.where(F.size("vector") == width)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    ids = taken.column("vec_id").to_numpy()
    sampled = _matrix(taken.column("vector").combine_chunks() if taken.num_rows else pa.array([], pa.list_(pa.float64())), width)
    tree = fit_tree(sampled)
    visits = _calibrated(rows, tree, list(zip(ids.tolist(), sampled, strict=True)), width, count, recall)

    def leaves(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(_matrix(batch.column(1), width)).astype(np.int32))], ["leaf"])

    def probes(batches):
        for batch in batches:
            found = [tree.visits(v, visits) for v in _matrix(batch.column(1), width)]
            sizes = [len(f) for f in found]
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            leaf = np.concatenate([np.array(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf)], ["query_id", "vector", "leaf"])

    queries = rows.where(F.col("vec_id") % every == 0)
    probed = queries.mapInArrow(probes, "query_id long, vector array<double>, leaf int")
    held = dict(rows.mapInArrow(leaves, "leaf int").groupBy("leaf").count().collect())
    asked = dict(probed.groupBy("leaf").count().collect())
    parts = {k: -(-n // CELL_VECTORS) for k, n in held.items()}
    shares = {k: -(-n // CELL_QUERIES) for k, n in asked.items()}

    def dealt(own: np.ndarray, leaf: np.ndarray, mine: dict, others: dict):
        """Row numbers and cell of every copy: an own part by hash, and every part of the other side."""
        other = np.array([others.get(k, 0) for k in leaf.tolist()], np.int64)
        row = np.repeat(np.arange(len(leaf)), other)
        second = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
        size = np.array([mine.get(k, 1) for k in leaf.tolist()], np.int64)
        first = ((own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % size
        return row, first[row].astype(np.int32), second.astype(np.int32)

    cell = "leaf int, part int, share int, id long, vector array<double>"
    names = ["leaf", "part", "share", "id", "vector"]

    def placed(batches):
        for batch in batches:
            leaf = tree.leaf_of(_matrix(batch.column(1), width)).astype(np.int32)
            row, part, share = dealt(batch.column(0).to_numpy(), leaf, parts, shares)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[row]), pa.array(part), pa.array(share), batch.column(0).take(at), batch.column(1).take(at)], names)

    def asking(batches):
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            row, share, part = dealt(batch.column(0).to_numpy(), leaf, shares, parts)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[row]), pa.array(part), pa.array(share), batch.column(0).take(at), batch.column(1).take(at)], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own, points = left.column("id").to_numpy(), _matrix(left.column("vector").combine_chunks(), width)
            for query, point in zip(right.column("id").to_pylist(), _matrix(right.column("vector").combine_chunks(), width), strict=True):
                near, distance = _nearest(own, points, query, point, count)
                found.append((query, near, distance, np.zeros(len(near))))
        return pa.Table.from_batches([_found(found)])

    keys = ["leaf", "part", "share"]
    cells = rows.mapInArrow(placed, cell).groupBy(*keys).cogroup(probed.mapInArrow(asking, cell).groupBy(*keys))
    return _best(cells.applyInArrow(meet, _FOUND), count).select("query_id", "rank", "vec_id", "score")
