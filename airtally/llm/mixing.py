"""Mixing sources to target weights, by whole blocks of documents.

*Targets.* Sources in code-point order, null last, get weights in turn and share a number of words;
none gets more than ``most`` times what it has, and the excess goes to the others by weight.

*Blocks.* The documents of a source stand in the order of a digest of their content, a fixed random
permutation. Ranges of the digest cut it into blocks, so a busy source has many blocks and no task
ever holds more than one of them. A source gives all its blocks as often as its target allows, and
once more the first blocks up to the target. Documents are taken whole: the one that the target
falls into is taken if that comes nearer to the target, so a source gives its target but for half
of one document.

*Splitting tree.* Blocks are counted for each source: that is its quota. The shards of the mix are
the leaves of a binary tree. A node draws which part of its blocks goes left, without replacement
over all sources at once (multivariate hypergeometric), and the rest goes right. A node's draw is
seeded with its place in the tree, so each leaf walks down from the root by itself and learns its
number of blocks of each source and how many went to leaves before it. It takes that range of the
source's quota, which an affine permutation spreads over blocks and repeats: leaves are disjoint
and use up the quotas. The leaf then shuffles its blocks.

The driver gets one row for each source. Documents are shuffled once, by block.

Defined cases: a null text has size 0; a document of size 0 is taken with 0 words and is not in the
mix; a null source is a source; a source without words has target 0; rows that repeat are documents
of their own, each taken at most ``most`` times its size; an empty table gives an empty table;
further columns are carried along whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 1024
#: Blocks at most, so that their numbers can be drawn; blocks grow beyond.
MOST_BLOCKS = 400_000_000
MOST_SOURCES = 100_000
SHARD_WORDS = 4_000_000
DIGEST_BITS = 60


@dataclass
class Source:
    """What a source has and gives."""

    name: str | None
    size: int
    blocks: int
    target: float
    #: Whole passes over the source, and words of one more pass.
    passes: int = 0
    rest: int = 0


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Share words by weight; none gets more than ``most`` times its size."""
    out, rest, open_ = [0.0] * len(sizes), share, set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ -= set(full)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(*content: Column) -> Column:
    """A number of 60 bits from a digest of a document's content, the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in content)))
    return F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("long")


def leaf_counts(quota: np.ndarray, leaves: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks of each source leaves before this one have, and how many this one has."""
    before, own = np.zeros_like(quota), quota
    low, high = 0, leaves
    while high - low > 1:
        middle = (low + high) // 2
        total = int(own.sum())
        random = np.random.default_rng([seed, low, high])
        left = random.multivariate_hypergeometric(own, total * (middle - low) // (high - low)) if total else own
        if leaf < middle:
            own, high = left, middle
        else:
            before, own, low = before + left, own - left, middle
    return before, own


def spread(n: int, seed: int, source: int) -> tuple[int, int]:
    """Factor and summand of a permutation of the numbers below ``n``."""
    random = np.random.default_rng([seed, source, n])
    factor = int(random.integers(1, max(2, min(n, 1 << 20))))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor, int(random.integers(0, max(n, 1)))


def draws(spark, sources: list[Source], quota: list[int], leaves: int, seed: int) -> DataFrame:
    """A row for each drawn block: ``src``, ``copy``, ``block``, its ``shard`` and place there."""
    counts, blocks = np.array(quota, dtype=np.int64), [s.blocks for s in sources]
    moves = [spread(k, seed, i) for i, k in enumerate(quota)]

    def leaf_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf in batch["id"].tolist():
                before, own = leaf_counts(counts, leaves, leaf, seed)
                src = np.repeat(np.arange(len(own)), own)
                slots = [(np.arange(b, b + n) * moves[i][0] + moves[i][1]) % quota[i] for i, (b, n) in enumerate(zip(before.tolist(), own.tolist(), strict=True)) if n]
                slot = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
                each = np.array(blocks)[src]
                order = np.random.default_rng([seed, leaves, leaf, 1]).permutation(len(src))
                yield pd.DataFrame({"src": src, "copy": slot // each, "block": slot % each, "shard": leaf, "nth": order})

    return spark.range(0, leaves, 1, min(leaves, 200)).mapInPandas(leaf_blocks, "src int, copy int, block long, shard int, nth long")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, shard_words: int = SHARD_WORDS,
    seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep_row: bool = True,
) -> DataFrame:
    """A row for each document: ``doc_id``, ``size``, ``source_size``, ``target`` of its source,
    ``taken`` words, ``draws`` and, with ``keep_row``, ``row`` with all columns.

    ``draws`` holds, for each time the document is in the mix, ``shard``, ``nth`` (place of the
    block in the shard), ``copy`` and ``words``, its size.
    """
    spark = docs.sparkSession
    text, source = docs[text_col], docs[source_col]
    kept = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if keep_row else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), source.cast("string").alias("source"), word_count(text).alias("size"), place(docs[id_col], text).alias("at"), *kept)
    if not keep_row:
        rows = materialize(rows, "sizes")  # the texts are read once
    shape = docs.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(source).alias("sources")).first()
    wanted = min(shape["n"] / BLOCK_DOCS, MOST_BLOCKS / (2 * shape["sources"] + 1))
    bits = max(4, math.ceil(math.log2(max(wanted, 1))))
    rows = rows.withColumn("bucket", F.shiftright("at", DIGEST_BITS - bits))

    # first words and numbers of blocks, summed in two steps so that a busy source has no long sum
    blocks = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("high", F.shiftright("bucket", bits // 2))
    blocks = materialize(blocks, "blocks")
    below = W.partitionBy("source").orderBy("high").rowsBetween(W.unboundedPreceding, -1)
    high = blocks.groupBy("source", "high").agg(F.sum("words").alias("w"), F.count("bucket").alias("c"))
    high = high.select("source", "high", F.coalesce(F.sum("w").over(below), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(below), F.lit(0)).alias("c0"))
    within = W.partitionBy("source", "high").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    numbered = blocks.select("source", "high", "bucket", F.coalesce(F.sum("words").over(within), F.lit(0)).alias("w"), F.coalesce(F.count("bucket").over(within), F.lit(0)).alias("c"))
    same = numbered["source"].eqNullSafe(high["source"]) & (numbered["high"] == high["high"])
    numbered = numbered.join(high, same).select(numbered["source"], "bucket", (F.col("w") + F.col("w0")).alias("first"), (F.col("c") + F.col("c0")).alias("block"))

    found = blocks.groupBy("source").agg(F.sum("words").alias("size"), F.count("bucket").alias("blocks")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    own = [weights[i % len(weights)] for i in range(len(found))]
    wanted = targets([r["size"] for r in found], own, share * sum(r["size"] for r in found), most)
    sources = [Source(r["source"], r["size"], r["blocks"], t) for r, t in zip(found, wanted, strict=True)]
    for s in sources:
        s.passes, s.rest = divmod(math.floor(s.target + 1e-6), s.size) if s.size else (0, 0)
    plan = spark.createDataFrame(
        [(i, s.name, s.size, s.target, s.passes, s.rest) for i, s in enumerate(sources)],
        "src int, name string, source_size long, target double, passes int, rest long",
    )
    named = F.broadcast(plan)  # at most MOST_SOURCES rows
    numbered = materialize(numbered.join(named, F.col("source").eqNullSafe(F.col("name"))).select("src", "bucket", "block", "first", "rest"), "numbered")
    more = {r["src"]: r["n"] for r in numbered.where("first < rest").groupBy("src").agg(F.count("block").alias("n")).collect()}
    quota = [s.passes * s.blocks + more.get(i, 0) for i, s in enumerate(sources)]
    leaves = max(1, math.ceil(sum(s.target for s in sources) / shard_words))
    drawn = draws(spark, sources, quota, leaves, seed).groupBy("src", "block").agg(F.collect_list(F.struct("copy", "shard", "nth")).alias("drawn"))
    of_block = materialize(numbered.join(drawn, ["src", "block"], "left").select("src", "bucket", "first", "drawn"), "draws")

    order = W.partitionBy("src", "bucket").orderBy("at", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        rows.join(named, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(of_block, ["src", "bucket"])
        .withColumn("start", F.col("first") + F.col("before"))
    )
    taken = F.expr("""filter(transform(coalesce(drawn, array()), d -> struct(d.shard AS shard, d.nth AS nth, d.copy AS copy,
        CASE WHEN d.copy < passes OR 2 * (rest - start) >= size THEN size ELSE 0L END AS words)), d -> d.words > 0)""")
    placed = placed.withColumn("draws", taken).withColumn("taken", F.expr("aggregate(draws, 0L, (t, d) -> t + d.words)"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "draws", *(["row"] if keep_row else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken. Each
    shard is in one partition, in its shuffled order."""
    rows = mix(docs, **options).select("row", F.explode("draws").alias("d"))
    rows = rows.repartition("d.shard").sortWithinPartitions("d.shard", "d.nth", F.xxhash64("d.copy", "row"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
