"""Approximate nearest neighbours by inner product, with a vantage-point tree per shard.

*Metric.* Candidates get one more component, the root of what their squared norm lacks of the
largest in the shard, and queries get a zero there. Then the candidates with the largest inner
product are those at the smallest Euclidean distance, and the triangle inequality holds.

*Tree.* A node has a vantage point and halves its vectors at the median distance from it; leaves are
small. Copies of a vector are at equal distances and are halved by rank, so a tree never
degenerates. All queries of a block walk down together: a node keeps the queries whose ball reaches
it and passes them on.

*Search.* A query's radius tau is the distance of its k-th best so far. Half a node is visited if
its distances from the vantage point come within ``factor * tau`` of the query's. With factor one
nothing is missed and the search is exact; a smaller factor visits less.

Shards have a bounded size. Every row is in the index of its shard, and each shard's tree is built
where its vectors are searched.

Defined cases: vectors that are null, zero, or hold null or infinite components or NaN, take no part,
nor do rows with a null id; vectors of different length never meet; a candidate that repeats is
found as often as it is there; candidates with the query's own id are left out; ties go to the
smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dots, nearest, usable

FACTOR = 0.2
LEAF = 128


@dataclass
class Node:
    """A subtree: its rows, and for inner nodes the vantage point and the range of distances on each side."""

    rows: np.ndarray
    vantage: np.ndarray | None = None
    near: Node | None = None
    far: Node | None = None
    near_most: float = 0.0
    far_least: float = 0.0
    near_least: float = 0.0
    far_most: float = 0.0


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - point) ** 2).sum(axis=1), 0))


def build(x: np.ndarray, rows: np.ndarray, leaf: int, random: np.random.Generator) -> Node:
    """The tree of some rows; the vantage point is the one of a few that spreads them most."""
    if len(rows) <= leaf:
        return Node(rows)
    points, sample = (x[random.choice(rows, n)] for n in (5, 64))
    vantage = max(points, key=lambda p: float(distances(sample, p).std()))
    own = distances(x[rows], vantage)
    order = np.argsort(own, kind="stable")
    half = len(rows) // 2
    near, far = order[:half], order[half:]
    return Node(
        rows, vantage,
        build(x, rows[near], leaf, random), build(x, rows[far], leaf, random),
        float(own[near[-1]]), float(own[far[0]]), float(own[near[0]]), float(own[far[-1]]),
    )


class Search:
    """The best candidates of each query so far, while all queries walk through a shard's tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, keep: int, factor: float) -> None:
        self.x, self.ids, self.q, self.q_ids, self.factor = x, ids, q, q_ids, factor
        # squares of distances are rounded, or equal vectors would be told apart by how they are summed
        self.unit = 1e-11 * max(float((x * x).sum(axis=1).max(initial=0)), float((q * q).sum(axis=1).max(initial=0)), 1e-300)
        self.squared = np.full((len(q), keep), np.inf)
        self.row = np.full((len(q), keep), -1, dtype=np.int64)
        self.taken = 0

    def leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        rows = np.sort(rows)  # rows are in the order of their ids
        q, points = self.q[at], self.x[rows]
        squared = (q * q).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * q @ points.T
        squared = np.maximum(np.round(squared / self.unit), 0) * self.unit
        squared[self.q_ids[at][:, None] == self.ids[rows]] = np.inf
        self.taken += squared.size
        better = (squared <= self.squared[at, -1:]).any(axis=1)
        at, squared = at[better], squared[better]
        both = np.concatenate([self.squared[at], squared], axis=1)
        names = np.concatenate([self.row[at], np.broadcast_to(rows, squared.shape)], axis=1)
        order = np.lexsort((names, both), axis=1)[:, : self.row.shape[1]]
        self.squared[at] = np.take_along_axis(both, order, axis=1)
        self.row[at] = np.take_along_axis(names, order, axis=1)

    def walk(self, node: Node, at: np.ndarray) -> None:
        """Search a subtree for the queries ``at``."""
        if not len(at):
            return
        if node.vantage is None:
            self.leaf(node.rows, at)
            return
        d = distances(self.q[at], node.vantage)
        self.taken += len(at)
        first = d <= (node.near_most + node.far_least) / 2
        # a query visits the side it is on, then the other one if its ball reaches it
        for side, ones in ((node.near, first), (node.far, ~first)):
            self.walk(side, at[ones])
        for side, ones, least, most in ((node.far, first, node.far_least, node.far_most), (node.near, ~first, node.near_least, node.near_most)):
            tau = np.sqrt(self.squared[at, -1])
            gap = np.maximum(least - d, d - most)
            self.walk(side, at[ones & (gap <= self.factor * tau + 1e-5 * np.sqrt(self.unit * 1e11))])


def searcher(k: int, factor: float, leaf: int):
    """The search of a block of queries in a shard; see :func:`nearest`."""

    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = (x * x).sum(axis=1)
        points = np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))])
        tree = build(points, np.arange(len(x)), leaf, np.random.default_rng(len(x)))
        # some more than k, as rounded distances may tie; scores decide
        found = Search(points, ids, np.column_stack([q, np.zeros(len(q))]), q_ids, k + 16, factor)
        found.walk(tree, np.arange(len(q)))
        at, nth = np.nonzero(np.isfinite(found.squared))
        row = found.row[at, nth]
        scores = dots(q[at], x[row])
        order = np.lexsort((ids[row], -scores, at))
        at, row, scores = at[order], row[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        return at[rank < k], ids[row][rank < k], scores[rank < k]

    return search


def near_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding", **blocks: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (inner product) of the k nearest that were found.

    ``is_query`` is a condition on ``vec_id``. A smaller ``factor`` is faster and finds less; one is
    exact. ``blocks`` are the numbers of candidates in a shard and of queries in a block.
    """
    rows = usable(vectors, id_col, vector_col).where(F.exists("vector", lambda c: c != 0))
    return nearest(rows, is_query, k, searcher(k, factor, leaf), "double", **blocks)
