"""Hard negatives by window searches in GNAT-style trees.

An anchor's positives are its nearest rows of the same label; a hard negative of a positive is a row of
another label whose score lies in a window below the positive's. Scores are inner products of
integer vectors.

*Metric.* Rows get one more component, the root of what their squared norm lacks of the largest,
and anchors get a zero there. Squared distances are then a constant less twice the score, so a
window of scores is an annulus around the anchor.

*Regions.* Split points from a bounded sample divide all rows by the nearest one. Each split point
stores the range of its distances to every region, its own and its siblings'. A region is left out
for an anchor if, for some split point, that range does not meet the distances which the annulus
allows. So only anchors travel, and only to regions that may hold an answer.

*Trees.* A region is cut into blocks of bounded size, and the rows of a block are divided again and
again in the same way. Leaves are compared exactly. While an anchor has all the rows that it asked
for, the least score among them narrows its annulus.

An anchor first visits its own region; what it finds there bounds the annulus of its positives in all
others. The windows of its positives are known then, so negatives take one pass.

Defined cases: rows with a null id or label, or a vector that is null or has null, infinite or NaN
components, take no part; vectors of different length never meet; rows with the anchor's id are not
compared with it; rows that repeat id, label and vector are searched once and count as often as
they are there; a repeated anchor is one anchor; ties go to the smaller id; a positive whose score is
negative has an empty window; an empty table gives an empty table; further columns are ignored.
A score that needs more than 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import discard, materialize

#: Rows of a block, anchors that meet it at a time, split points of a table, and the sample for them.
ROWS, ANCHORS, MOST_POINTS, SAMPLE = 8_192, 8_192, 64, 1_024
POINTS, LEAF = 8, 64
LEAST, MOST = -(2**63), 2**63 - 1


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all of ``x``, whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
    return np.array(whole, dtype=np.int64).reshape(len(q), len(x))


@dataclass
class Space:
    """Distances of rows whose squared norm is at most ``largest``."""

    largest: float

    @property
    def slack(self) -> float:
        return 1e-6 * (math.sqrt(self.largest) + 1)

    def lack(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))

    def between(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """From rows to split points."""
        lacks, others = self.lack(x), self.lack(points)
        own, other = (x * x).sum(axis=1) + lacks**2, (points * points).sum(axis=1) + others**2
        return np.sqrt(np.maximum(own[:, None] + other - 2 * (x @ points.T) - 2 * np.outer(lacks, others), 0))

    def from_anchors(self, q: np.ndarray, points: np.ndarray) -> np.ndarray:
        other = (points * points).sum(axis=1) + self.lack(points) ** 2
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + other - 2 * (q @ points.T), 0))

    def annulus(self, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Radii within which scores from ``low`` to ``high`` lie, for anchors of these squared norms."""
        outer, inner = (np.sqrt(np.maximum(norms + self.largest - 2 * s.astype(np.float64), 0)) for s in (low, high))
        return np.maximum(inner - self.slack, 0), outer + self.slack


def reached(d: np.ndarray, inner: np.ndarray, outer: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether an annulus may hold rows at distances ``least`` to ``most`` from the split points,
    which lie at ``d`` from its centre."""
    nearest = np.maximum(d - outer[:, None], inner[:, None] - d)
    # what cannot be computed leaves nothing out
    return ~((nearest > most) | (d + outer[:, None] < least)).any(axis=1)


def far_apart(x: np.ndarray, n: int, space: Space) -> np.ndarray:
    """Numbers of up to ``n`` different rows, each the farthest from those before it."""
    chosen = [0]
    gap = space.between(x, x[:1])[:, 0]
    while len(chosen) < n:
        at = int(gap.argmax())
        if gap[at] <= space.slack:
            break
        chosen.append(at)
        gap = np.minimum(gap, space.between(x, x[at : at + 1])[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    """A subtree: its rows, and for inner nodes split points, a child for each, and ``least[i, j]`` to
    ``most[i, j]``, the distances of split point i to the rows of child j."""

    rows: np.ndarray
    points: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def build(x: np.ndarray, rows: np.ndarray, space: Space, random: np.random.Generator, points: int = POINTS, leaf: int = LEAF) -> Node:
    """The tree of some rows; rows that cannot be told apart are a leaf."""
    if len(rows) <= leaf:
        return Node(rows)
    sample = random.choice(rows, min(len(rows), 8 * points), replace=False)
    chosen = x[sample[far_apart(x[sample], points, space)]]
    d = space.between(x[rows], chosen)
    side = d.argmin(axis=1)
    parts = [np.flatnonzero(side == j) for j in range(len(chosen))]
    if max(map(len, parts)) == len(rows):
        return Node(rows)
    full = [p for p in parts if len(p)]
    least, most = (np.stack([f(d[p], axis=0) for p in full], axis=1) for f in (np.min, np.max))
    return Node(rows, chosen, [build(x, rows[p], space, random, points, leaf) for p in full], least, most)


class Search:
    """The best rows of each anchor so far, while all anchors of a block walk through its tree."""

    def __init__(self, space: Space, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: pd.DataFrame, keep: int) -> None:
        self.space, self.x, self.ids, self.labels, self.keep = space, x, ids, labels, keep
        self.q, self.q_ids, self.q_labels = np.stack(q["vector"].to_numpy()), q["anchor_id"].to_numpy(), q["label"].to_numpy()
        self.same, self.low, self.high = q["same"].to_numpy(), q["low"].to_numpy().copy(), q["high"].to_numpy()
        self.norms = (self.q * self.q).sum(axis=1)
        self.score = np.full((len(q), keep), LEAST, dtype=np.int64)
        self.row = np.full((len(q), keep), len(ids), dtype=np.int64)
        self.compared = 0

    def leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        rows = np.sort(rows)  # rows are in the order of their ids
        found = scores(self.q[at], self.x[rows])
        self.compared += found.size
        fits = (found >= self.low[at, None]) & (found <= self.high[at, None]) & (self.q_ids[at, None] != self.ids[rows])
        fits &= (self.q_labels[at, None] == self.labels[rows]) == self.same[at, None]
        some = fits.any(axis=1)
        at, found, fits = at[some], found[some], fits[some]
        both = np.concatenate([self.score[at], np.where(fits, found, LEAST)], axis=1)
        names = np.concatenate([self.row[at], np.where(fits, rows, len(self.ids))], axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, : self.keep]  # ~ turns the order round, without overflow
        self.score[at] = np.take_along_axis(both, order, axis=1)
        self.row[at] = np.take_along_axis(names, order, axis=1)
        full = at[self.row[at, -1] < len(self.ids)]
        self.low[full] = np.maximum(self.low[full], self.score[full, -1])

    def walk(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.points is None:
            self.leaf(node.rows, at)
            return
        d = self.space.from_anchors(self.q[at], node.points)
        self.compared += d.size
        home = np.array([np.maximum(node.least[:, j] - d, d - node.most[:, j]).max(axis=1) for j in range(len(node.children))]).argmin(axis=0)
        for j, child in enumerate(node.children):
            self.walk(child, at[home == j])
        for j, child in enumerate(node.children):
            inner, outer = self.space.annulus(self.norms[at], self.low[at], self.high[at])
            self.walk(child, at[(home != j) & reached(d, inner, outer, node.least[:, j], node.most[:, j])])


@dataclass
class Table:
    """The split points of all rows of one width, ``least[i, j]`` and ``most[i, j]`` of point i to region j,
    and the number of blocks of each region."""

    points: np.ndarray
    least: np.ndarray
    most: np.ndarray
    blocks: np.ndarray


class Index:
    """All rows, in regions; see the module."""

    def __init__(self, rows: DataFrame, scale: int, block_rows: int, block_anchors: int) -> None:
        self.block_rows, self.block_anchors = block_rows, block_anchors
        rows = rows.withColumn("width", F.size("vector"))
        norm = F.aggregate("vector", F.lit(0.0), lambda s, c: s + F.pow(c * scale, 2) + 2 * F.abs(c * scale) + 1)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).first()
        self.space = space = Space(float(size["largest"] or 0))
        sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("width", "vector").collect()
        most = min(MOST_POINTS, max(2, math.ceil(size["n"] / block_rows)))
        points: dict[int, np.ndarray] = {}
        for width in {r["width"] for r in sample if r["width"]}:
            own = np.floor(np.array([r["vector"] for r in sample if r["width"] == width], dtype=np.float64) * scale)
            points[width] = own[far_apart(own, most, space)]

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, part in batch.groupby("width"):
                    x = np.floor(np.stack(part["vector"].to_numpy()).astype(np.float64) * scale)
                    own = points.get(width)
                    d = space.between(x, own) if own is not None else np.zeros((len(x), 0))
                    region = d.argmin(axis=1) if d.shape[1] else np.zeros(len(x), dtype=np.int64)
                    yield part.assign(vector=list(x), region=region.astype(np.int32), distances=list(d))

        placed = rows.mapInPandas(assign, "vec_id long, label long, vector array<double>, copies long, width int, region int, distances array<double>")
        self.rows = materialize(placed, "regions")
        ranges = self.rows.select("width", "region", F.posexplode_outer("distances").alias("point", "d")).groupBy("width", "region", "point")
        found = ranges.agg(F.min("d").alias("least"), F.max("d").alias("most"), F.count(F.lit(1)).alias("n")).collect()
        self.tables: dict[int, Table] = {}
        for width in {r["width"] for r in found}:
            own = points.get(width, np.zeros((0, width)))
            m = max(1, len(own))
            # a region without rows is never reached
            table = Table(own, np.full((len(own), m), np.inf), np.full((len(own), m), -np.inf), np.zeros(m, dtype=np.int64))
            for r in (r for r in found if r["width"] == width):
                if r["point"] is not None:
                    table.least[r["point"], r["region"]], table.most[r["point"], r["region"]] = r["least"], r["most"]
                table.blocks[r["region"]] = math.ceil(r["n"] / block_rows)
            self.tables[width] = table

    def search(self, anchors: DataFrame, keep: int, home: bool | None = None) -> DataFrame:
        """``anchor_id``, ``mark``, ``nth``, and ``vec_id``, ``score`` and ``copies`` of rows, among which are the
        ``keep`` best of each anchor's window.

        ``anchors`` have ``vector``, ``width``, ``label``, ``same`` (whether rows of that label or of others
        are wanted), and a window from ``low`` to ``high``. ``home`` searches the region that the
        anchor is nearest to only, or all others only.
        """
        tables, space = self.tables, self.space
        names = ["anchor_id", "mark", "nth", "label", "vector", "width", "same", "low", "high"]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, part in batch.groupby("width"):
                    table, q = tables[width], np.stack(part["vector"].to_numpy())
                    d = space.from_anchors(q, table.points)
                    inner, outer = space.annulus((q * q).sum(axis=1), part["low"].to_numpy(), part["high"].to_numpy())
                    near = d.argmin(axis=1) if d.shape[1] else np.zeros(len(q), dtype=np.int64)
                    for region in np.flatnonzero(table.blocks).tolist():
                        goes = reached(d, inner, outer, table.least[:, region], table.most[:, region])
                        if home is not None:
                            goes &= (near == region) == home
                        for block in range(int(table.blocks[region])):
                            yield part[goes].assign(region=np.int32(region), block=np.int32(block))

        kinds = "anchor_id long, mark long, nth int, label long, vector array<double>, width int, same boolean, low long, high long"
        groups = max(1, math.ceil(anchors.count() / self.block_anchors))
        sent = anchors.select(*names).mapInPandas(route, f"{kinds}, region int, block int").withColumn("q", F.pmod(F.xxhash64("anchor_id", "mark", "nth"), F.lit(groups)).cast("int"))
        blocks = [[w, r, int(n)] for w, t in tables.items() for r, n in enumerate(t.blocks.tolist()) if n]
        number = self.rows.sparkSession.createDataFrame(blocks or [[0, 0, 1]], "width int, region int, n int")
        # at most MOST_POINTS rows for each width
        rows = self.rows.join(F.broadcast(number), ["width", "region"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), "n").cast("int"))
        rows = rows.select("vec_id", "label", "vector", "copies", "width", "region", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"anchor_id": [], "mark": [], "nth": [], "vec_id": [], "score": [], "copies": []})
            right = right.sort_values(["vec_id", "label"], kind="stable")
            x, ids = np.stack(right["vector"].to_numpy()), right["vec_id"].to_numpy()
            tree = build(x, np.arange(len(x)), space, np.random.default_rng(len(x)))
            found = Search(space, x, ids, right["label"].to_numpy(), left, keep)
            found.walk(tree, np.arange(len(left)))
            at, nth = np.nonzero(found.row < len(ids))
            row = found.row[at, nth]
            own = left[["anchor_id", "mark", "nth"]].iloc[at].reset_index(drop=True)
            return own.assign(vec_id=ids[row], score=found.score[at, nth], copies=right["copies"].to_numpy()[row])

        keys = ("width", "region", "block", "q")
        return sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(cell, "anchor_id long, mark long, nth int, vec_id long, score long, copies long")


def ranked(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best rows of each anchor, as ``rank``, with repeats as often as they are there."""
    every = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(keep)).cast("int"))))
    best = W.partitionBy("anchor_id", "mark", "nth").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).drop("copy", "copies")


def floor_div(a: Column, b: int) -> Column:
    """Whole part of a quotient of whole numbers, rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int = ROWS, block_anchors: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``is_anchor`` is a condition on ``vec_id``. Components become ``floor(scale * x)``. The negatives
    of a positive score from ``low`` to ``high`` percent of what the positive does.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    index = Index(rows.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies")), scale, block_rows, block_anchors)
    window = [F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")]
    anchors = index.rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vector").alias("mark"), F.lit(0).alias("nth"), "label", "vector", "width")
    anchors = anchors.dropDuplicates(["anchor_id", "mark"])
    asking = anchors.withColumn("same", F.lit(True))
    near = materialize(ranked(index.search(asking.select("*", *window), positives, home=True), positives), "near")
    # the least of as many scores as are wanted bounds the rest
    bound = near.where(F.col("rank") == positives).select("anchor_id", "mark", F.col("score").alias("bound"))
    rest = asking.join(bound, ["anchor_id", "mark"], "left").select("*", F.coalesce("bound", F.lit(LEAST)).alias("low"), F.lit(MOST).alias("high"))
    far = ranked(index.search(rest, positives, home=False), positives)
    found = ranked(near.unionByName(far).withColumn("copies", F.lit(1)), positives)
    found = found.select("anchor_id", "mark", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = materialize(found, "positives")
    s = F.col("positive_score")
    below = anchors.drop("nth").join(found, ["anchor_id", "mark"])
    below = below.withColumn("same", F.lit(False)).withColumn("low", -floor_div(-low * s, 100)).withColumn("high", floor_div(high * s, 100)).where("low <= high")
    hard = ranked(index.search(below, negatives), negatives)
    out = hard.join(found, ["anchor_id", "mark", "nth"])
    out = materialize(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    for table in (index.rows, near, found):
        discard(table)
    return out
