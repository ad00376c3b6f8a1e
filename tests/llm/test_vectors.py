"""Searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtally.llm import top_k, vp_tree

SCHEMA = "vec_id long, embedding array<float>, score string"


def vectors(spark, n=600, width=12):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(n, width)).astype(np.float32)
    x[100:140] = x[100]  # many copies
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(1000, None), (1001, [None] * width), (1002, [float("nan")] * width), (1003, [float("inf")] * width), (1040, [0.0] * width), (1050, [1.0, 2.0]), (1100, [2.0, 1.0]), (1060, []), (None, x[0].tolist()), (50, x[50].tolist())]
    return spark.createDataFrame([(i, v, "z") for i, v in rows], SCHEMA).repartition(3), rows


def brute(rows, every, k, value, zero):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    usable = [(i, v) for i, v in usable if zero or (v != 0).any()]
    out = {}
    for q, v in usable:
        if q % every == 0:
            found = sorted((-value(v, w), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 90, "query_block": 5}])
def test_top_k_is_exact(spark, blocks):
    df, rows = vectors(spark)
    scaled = lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)) if len(a) else 0
    got = results(top_k.top_k(df, F.col("vec_id") % 50 == 0, **blocks))
    assert got == {q: f for q, f in brute(rows, 50, 5, scaled, True).items() if f}


def test_large_components_stay_exact():
    q, x = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [2.0**21, -1.0]])
    assert top_k.exact(q, x).tolist() == [2**60 + 3, 2**61 - 3]
    with pytest.raises(OverflowError):
        top_k.exact(q, np.array([[2.0**40, 0.0]]))


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 90, "query_block": 5}])
def test_factor_one_is_exact(spark, blocks):
    df, rows = vectors(spark)
    got = results(vp_tree.near_neighbours(df, F.col("vec_id") % 20 == 0, factor=1.0, leaf=8, **blocks))
    wanted = brute(rows, 20, 20, lambda a, b: float(sum(a * b)), False)
    for q, found in wanted.items():
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in found]
        assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in found], rtol=0, atol=1e-12)


def test_default_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    got = results(vp_tree.near_neighbours(df, F.col("vec_id") % 20 == 0))
    hits = 0
    for n in np.flatnonzero(ids % 20 == 0):
        score = x @ x[n]
        score[n] = -np.inf
        hits += len({i for i, _ in got[ids[n]]} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert vp_tree.near_neighbours(df, F.col("vec_id") % 20 == 0).count() == 0
