"""Blocks of vectors for searches of a stated query set against all rows.

Candidates and queries are dealt into blocks of bounded size, and each pair of blocks meets in a
task as a pair of matrices. No row of the result is a pair before it is among the best of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` of rows with an id and a vector of finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)


def nearest(rows: DataFrame, is_query: Column, k: int, search: Callable, score_type: str, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best candidates of every query.

    ``search(query_ids, queries, ids, candidates)`` gives arrays of the query's number, ``vec_id``
    and score that hold every query's k best of the block, ties to the smaller ``vec_id``, without
    rows of the query's own id. Vectors meet those of their own length only. A query row that
    repeats an id and vector is one query.
    """
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, q_blocks = max(1, math.ceil(counts["n"] / candidate_block)), max(1, math.ceil(counts["q"] / query_block))
    rows = rows.withColumn("width", F.size("vector"))
    deal = F.xxhash64("vec_id", "vector")
    # a copy of each candidate for every block of queries, and the other way round
    candidates = rows.select("vec_id", "vector", "width", F.pmod(deal, n_blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "vector"])
    queries = queries.select("vec_id", "vector", "width", F.pmod(deal, q_blocks).cast("int").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        right = right.sort_values("vec_id", kind="stable")
        q_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, x = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        at, found, scores = search(q_ids, q, ids, x)
        return pd.DataFrame({"query_id": q_ids[at], "query": left["mark"].to_numpy()[at], "vec_id": found, "score": scores})

    keys = ("block", "q_block", "width")
    marked = queries.withColumn("mark", F.xxhash64("vector"))
    cells = marked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(cell, f"query_id long, query long, vec_id long, score {score_type}")
    best = W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last in double precision."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[:, j] * x[:, j]
    return out
