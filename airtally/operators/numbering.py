"""Row numbers over a whole report and file chunks, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import use_checkpoint_dir


def _ranged(df: DataFrame, order: Sequence) -> DataFrame:
    """Rows in sorted ranges, ``_range`` in which and ``_id`` counting up inside it from 0.

    Range bounds are sampled, so the sorted ranges are checkpointed with their places:
    counting and numbering must see the same ones, also after an executor is lost.
    """
    use_checkpoint_dir(df.sparkSession)
    # ids count up from 0 within a partition, whose number is in the bits above the 33rd
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    return placed.withColumns({"_range": F.shiftright("_id", 33), "_id": F.col("_id").bitwiseAND((1 << 33) - 1)})


def number_rows(df: DataFrame, order: Sequence, name: str = "row_num") -> DataFrame:
    """1..n in the given total order, with one shuffle.

    A row's number is its place within its range on top of the counts of the ranges before.
    """
    ranged = _ranged(df, order)
    per_range = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per range: at most the number of shuffle partitions
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_id") + F.col("_offset") + 1).drop("_range", "_offset", "_id")


def rank_rows(df: DataFrame, order: Sequence, name: str = "rank") -> DataFrame:
    """``rank()`` over the whole frame: rows alike in ``order`` share the number of the first.

    Ranges are cut by a hash of the row as well, so rows that are alike may fill several
    of them. Each range knows its first and last key; where the first one goes on from the
    range before, its rows get the number at which it began there or earlier.
    """
    spread = F.xxhash64(*df.columns)
    keys = [f"_o{i}" for i in range(len(order))]
    named = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, _plain(order))})
    ranged = _ranged(named, [*_ordered(keys, order), spread])
    own = F.rank().over(W.partitionBy("_range").orderBy(*_ordered(keys, order)))
    ranked = ranged.withColumn("_in", own)
    key = F.struct(*keys)
    ends = ranked.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(key, "_id").alias("_first"), F.max_by(key, "_id").alias("_last"), F.max("_in").alias("_last_in")
    )
    # one row per range from here on
    line = W.orderBy("_range")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumns(
        {"_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_goes_on": F.coalesce(F.lag("_last").over(line).eqNullSafe(F.col("_first")), F.lit(False))}
    ).withColumn("_goes_on", F.col("_goes_on") & (F.col("_offset") > 0))
    begins_here = ~(F.col("_goes_on") & (F.col("_last_in") == 1))
    ends = ends.withColumn("_began", F.when(begins_here, F.col("_offset") + F.col("_last_in")))
    ends = ends.withColumn("_carried", F.last("_began", ignorenulls=True).over(before)).select("_range", "_offset", "_goes_on", "_carried")
    number = F.when(F.col("_goes_on") & (F.col("_in") == 1), F.col("_carried")).otherwise(F.col("_offset") + F.col("_in"))
    return ranked.join(F.broadcast(ends), "_range").select(*df.columns, number.alias(name))


def _ordered(names: Sequence[str], order: Sequence) -> list:
    """The same directions for other columns: names stand for ascending order, ``("name", "desc")`` for descending."""
    return [F.desc(n) if isinstance(o, tuple) and o[1] == "desc" else F.asc(n) for n, o in zip(names, order)]


def _plain(order: Sequence) -> list:
    return [o[0] if isinstance(o, tuple) else o for o in order]


def ordinals(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = (), name: str = "ordinal", slice_seconds: int = 3600) -> DataFrame:
    """1..n for the rows of each key, in the order of time and ``tiebreak`` (together unique in a key).

    A key is cut into slices of time that are sorted on their own; a row's number is its
    place in its slice on top of the counts of the slices before. A busy key fills many tasks.
    """
    sliced = df.withColumn("_slice", F.floor(F.unix_timestamp(ts) / slice_seconds))
    cell = [*keys, "_slice"]
    inside = sliced.withColumn("_in", F.row_number().over(W.partitionBy(*cell).orderBy(ts, *tiebreak)))
    counts = sliced.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)]
    return inside.join(counts, same, "left").select(*df.columns, (F.col("_in") + F.col("_offset")).alias(name))


def chunk_rows(df: DataFrame, order: Sequence[str], max_rows: int, name: str = "row_partition") -> DataFrame:
    """Number the rows and assign them to files of at most ``max_rows``, from 1."""
    numbered = number_rows(df, order)
    return numbered.withColumn(name, F.ceil(F.col("row_num") / max_rows).cast("bigint"))
