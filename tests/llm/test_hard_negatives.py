"""Hard negatives against a comparison of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airtally.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, score string, region int"


def brute(rows, every, positives, negatives, low, high, scale=256):
    usable = [(i, label, np.floor(scale * np.array(v, dtype=np.float64))) for i, label, v in rows if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    anchors = {(i, label, tuple(v)) for i, label, v in usable if i % every == 0}
    out = []
    for a, label, v in anchors:
        scored = [(-int(np.dot(v, w)), i, own) for i, own, w in usable if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def check(spark, rows, every=10, positives=5, negatives=5, low=80, high=100, **options):
    frame = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], SCHEMA).repartition(3)
    got = hn.mine(frame, F.col("vec_id") % every == 0, positives, negatives, low, high, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every, positives, negatives, low, high)


def clustered(seed, n, width, clusters=12, noise=0.15):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    x = centres[rnd.integers(0, clusters, n)] + noise * rnd.normal(size=(n, width))
    return [(i, int(rnd.integers(0, 4)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "block_anchors": 7}])
def test_clustered_rows(spark, options):
    check(spark, clustered(1, 700, 8), **options)


def test_rows_of_all_kinds(spark):
    rows = clustered(2, 200, 5)
    rows += [(300 + i, 1, rows[40][2]) for i in range(30)]  # equal vectors
    rows += [rows[10], rows[10], (10, 3, rows[11][2])]  # repeated rows, and another row of the same id
    rows += [(401, None, rows[0][2]), (None, 1, rows[0][2]), (402, 1, None), (403, 1, [None] * 5), (404, 2, [float("nan")] * 5), (405, 2, [float("inf")] * 5)]
    rows += [(410, 1, [0.0] * 5), (420, 1, [1.0, 2.0]), (421, 1, [1.0, 1.0]), (422, 2, [1.0, 1.2]), (430, 1, []), (431, 1, []), (432, 2, [])]
    check(spark, rows, block_rows=50)
    check(spark, [], every=10)
    check(spark, [(0, 1, [1.0]), (1, 2, [0.9])])


def test_scores_that_are_not_positive(spark):
    check(spark, [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.9, 0.0]), (3, 2, [0.0, 0.0]), (4, 1, [0.0, 0.0]), (5, 3, [0.0, 1.0])])


def test_most_of_a_clustered_table_is_left_out():
    rnd = np.random.default_rng(5)
    centres = 40 * rnd.normal(size=(50, 16))
    x = np.floor(centres[rnd.integers(0, 50, 8000)] * 8 + 20 * rnd.normal(size=(8000, 16)))
    space = hn.Space(float((x * x).sum(axis=1).max()))
    tree = hn.build(x, np.arange(8000), space, np.random.default_rng(0))
    q = pd.DataFrame({"anchor_id": np.arange(80), "label": 0, "vector": list(x[:80]), "same": False, "low": (x[:80] ** 2).sum(axis=1).astype(np.int64) * 8 // 10, "high": (x[:80] ** 2).sum(axis=1).astype(np.int64)})
    found = hn.Search(space, x, np.arange(8000), np.ones(8000, dtype=np.int64), q, 5)
    found.walk(tree, np.arange(80))
    assert found.compared < 0.5 * 80 * 8000
    s = (x[:80] @ x.T).astype(np.int64)
    for i in range(80):
        fits = np.flatnonzero((s[i] >= q["low"][i]) & (s[i] <= q["high"][i]) & (np.arange(8000) != i))
        assert found.row[i][found.row[i] < 8000].tolist() == fits[np.lexsort((fits, -s[i][fits]))][:5].tolist()


def test_scores_beyond_doubles():
    assert hn.scores(np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**21, -1.0]])).tolist() == [[2**60 + 3, 2**61 - 3]]
    with pytest.raises(OverflowError):
        hn.scores(np.array([[2.0**60]]), np.array([[2.0**60]]))
