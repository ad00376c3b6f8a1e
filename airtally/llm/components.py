"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for nodes other than roots.

    ``edges`` has two columns of one orderable type, in any direction and with repeats; edges with
    a null end and loops say nothing. Each node is known to its root alone in the end, so a round
    never has more edges than the first one. The driver gets one row for each round.
    """
    u, v = edges.columns
    known = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        state = known.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return known.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        after = materialize(small_star(large_star(known)), "edges")
        discard(known)
        known = after
