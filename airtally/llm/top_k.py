"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is summed up by the mean and the deviation of each of its segments, for one segment,
then for more and more. In each segment the squared distance of two vectors is at least the length
times the squares of the differences of means and of deviations; with the squared norms, that
bounds the inner product from above. Bounds go from coarse to fine: candidates whose bound is below
the k-th best score known so far are gone, and what survives the finest level is scored exactly.

Components are scaled to integers, floor(scale * x), and scores are exact integers.

Defined cases: vectors that are null, or hold null or infinite components or NaN, take no part, nor
do rows with a null id; vectors of different length never meet; an empty vector scores 0 with other
empty ones; a candidate that repeats is found as often as it is there; candidates with the query's
own id are left out; ties go to the smaller id; an empty table gives an empty table; scores that
do not fit 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import nearest, usable

LEVELS = (1, 4, 16)
#: Queries of a block that are bounded at a time.
QUERIES_AT_ONCE = 256


def segment_bounds(width: int, segments: int) -> list[int]:
    return [width * i // segments for i in range(segments + 1)]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length."""
    bounds = segment_bounds(x.shape[1], min(segments, x.shape[1]))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = x[:, a:b]
        root = np.sqrt(b - a)
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """Scaled components, as doubles that are whole numbers."""
    return np.floor(x * scale)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one integer vector with several."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (x @ q).astype(np.int64)
    # too large for doubles: Python's integers, and an error if a result needs more than 64 bits
    return np.array([sum(int(a) * int(b) for a, b in zip(q, row, strict=True)) for row in x], dtype=np.int64)


def searcher(k: int, scale: int, levels: tuple[int, ...]):
    """The search of a block of queries in a block of candidates; see :func:`nearest`."""

    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, x = integers(q, scale), integers(x, scale)
        levels_x, levels_q = ([statistics(v, n) for n in levels] if v.shape[1] else [] for v in (x, q))
        norms_x, norms_q = (x * x).sum(axis=1), (q * q).sum(axis=1)
        slack = 1e-9 * (norms_x.max(initial=0) + norms_q.max(initial=0)) + 1e-6
        at, found, scores = [], [], []
        for start in range(0, len(q), QUERIES_AT_ONCE):
            part = slice(start, start + QUERIES_AT_ONCE)
            # the distance of the statistics is at most that of the vectors, so their product bounds the score
            coarse = upper(norms_q[part], levels_q[0][part], norms_x, levels_x[0]) if levels_x else np.zeros((len(q[part]), len(x)))
            for i in range(len(coarse)):
                own = q[start + i]
                alive = np.flatnonzero(ids != q_ids[start + i])
                if not len(alive):
                    continue
                bound = coarse[i, alive]
                # a first guess at the k-th best score: the exact scores of the best bounds
                tried = min(len(alive), 4 * k)
                first = np.argpartition(-bound, tried - 1)[:tried]
                known = np.sort(exact(own, x[alive[first]]))
                least = known[-k] if len(known) >= k else None
                for level in range(len(levels_x)):
                    if level:
                        bound = upper(norms_q[start + i : start + i + 1], levels_q[level][start + i : start + i + 1], norms_x[alive], levels_x[level][alive])[0]
                    if least is not None:
                        alive = alive[bound + slack >= least]
                score = exact(own, x[alive])
                best = np.lexsort((ids[alive], -score))[:k]
                at.append(np.full(len(best), start + i))
                found.append(ids[alive][best])
                scores.append(score[best])
        return tuple(np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (at, found, scores))

    return search


def upper(norms_q: np.ndarray, stats_q: np.ndarray, norms_x: np.ndarray, stats_x: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products: half of both squared norms less the least squared distance.

    The squared norms of the statistics are those of the vectors, so this is their product.
    """
    distance = (stats_q * stats_q).sum(axis=1)[:, None] + (stats_x * stats_x).sum(axis=1) - 2 * (stats_q @ stats_x.T)
    return (norms_q[:, None] + norms_x - distance) / 2


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, levels: tuple[int, ...] = LEVELS, id_col: str = "vec_id", vector_col: str = "embedding", **blocks: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k highest integer inner products.

    ``is_query`` is a condition on ``vec_id``. ``blocks`` are the numbers of candidates and queries
    in a block.
    """
    rows = usable(vectors, id_col, vector_col)
    return nearest(rows, is_query, k, searcher(k, scale, levels), "long", **blocks).select("query_id", "rank", "vec_id", F.col("score"))
