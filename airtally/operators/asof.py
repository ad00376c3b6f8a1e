"""Nearest-row and running lookups between two event streams.

The textbook form of these operators joins every event of one side with every earlier
event of the other side and ranks the pairs, so a key with n events on each side costs
n*n rows. Here both sides are united and sorted once per key: linear, whatever the key
holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Every key is cut into slices of this length, whatever it holds: a key with a third of 10^12
# rows in a year has 4 * 10^7 in a slice, and no key has more than 8,784 slices in a year.
SLICE_SECONDS = 3600


def _of_all(columns: Sequence[str]) -> Column:
    """True, in a form that needs all the columns. A plan that needs the same columns of
    a shuffle as another one reads the other's shuffle instead of making its own."""
    return F.pmod(F.hash(*columns), F.lit(1)) == 0


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    carry: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    direction: str = "backward",
    how: str = "inner",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """For each ``left`` row look at the ``right`` rows of the same key that lie at or
    before it (``backward``) or at or after it (``forward``).

    Adds ``hit``, a struct (``ts``, tiebreak, carry) of the nearest of them, and one
    column per entry of ``sums``: that expression summed over all of them. Among right
    rows at the nearest instant the largest tiebreak wins going backward, the smallest
    going forward. ``how="inner"`` keeps left rows with a hit, ``"left"`` keeps all;
    rows with a null key never match.

    A scan in two levels: each slice of a key is sorted on its own, and what the slices
    on the way to it leave behind, the nearest row and the totals, is carried over from
    one row per slice. Both levels read the same shuffle. Shorter slices suit logs in
    which one key has millions of rows within an hour.
    """
    sums = dict(sums or {})
    keys = list(on)
    backward = direction == "backward"
    side_cols = [f"_k{i}" for i in range(len(keys))]
    cell = [*side_cols, "_slice"]

    named = [F.col(k).alias(s) for k, s in zip(keys, side_cols)]
    own = [f"_l{i}" for i in range(len(left.columns))]
    rows_left = left.where(_all_present([*keys, left_ts])).select(
        *named, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), *[F.col(c).alias(o) for c, o in zip(left.columns, own)]
    )
    rows_right = right.where(_all_present([*keys, right_ts])).select(
        *named,
        F.col(right_ts).alias("_ts"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_ts).alias("ts"), *tiebreak, *[c for c in carry if c not in tiebreak]).alias("_hit"),
        *[expr.alias(f"_v{i}") for i, expr in enumerate(sums.values())],
    )
    rows = rows_left.unionByName(rows_right, allowMissingColumns=True)
    sliced = rows.withColumn("_slice", F.floor(F.unix_timestamp("_ts") / slice_seconds)).repartition(*cell)

    order = ("_ts", "_side", "_hit") if backward else (F.desc("_ts"), F.asc("_side"), F.desc("_hit"))
    so_far = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = sliced.select(
        *cell,
        "_side",
        *own,
        F.last("_hit", ignorenulls=True).over(so_far).alias("_near"),
        *[F.sum(f"_v{i}").over(so_far).alias(f"_in{i}") for i in range(len(sums))],
    ).where((F.col("_side") == 1) & _of_all(own))

    nearest = F.max if backward else F.min
    per_slice = sliced.groupBy(*cell).agg(
        nearest(F.when(F.col("_side") == 0, F.struct("_ts", "_hit"))).alias("_best"),
        F.count_if((F.col("_side") == 1) & _of_all(own)).alias("_asks"),
        *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))],
    )
    slice_order = F.asc("_slice") if backward else F.desc("_slice")
    passed = W.partitionBy(*side_cols).orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)
    left_behind = per_slice.select(
        *cell,
        "_asks",
        F.last("_best", ignorenulls=True).over(passed).alias("_before"),
        *[F.sum(f"_t{i}").over(passed).alias(f"_pre{i}") for i in range(len(sums))],
    ).where(F.col("_asks") > 0)

    out = inside.join(left_behind, cell, "left").select(
        *[F.col(o).alias(c) for c, o in zip(left.columns, own)],
        F.coalesce("_near", "_before._hit").alias("hit"),
        *[
            F.coalesce(F.coalesce(f"_in{i}", F.lit(0)) + F.coalesce(f"_pre{i}", F.lit(0)), F.lit(0)).alias(name)
            for i, name in enumerate(sums)
        ],
    )
    if how == "inner":
        return out.where(F.col("hit").isNotNull())
    unkeyed = left.where(~_all_present([*keys, left_ts]))
    return out.unionByName(
        unkeyed.select("*", *[F.lit(0).cast(out.schema[n].dataType).alias(n) for n in sums]), allowMissingColumns=True
    )


def day_lookup(
    left: DataFrame,
    right_daily: DataFrame,
    on: Sequence[str],
    left_day: str,
    right_day: str,
    measures: Mapping[str, Column],
    lo: int | None,
    hi: int | None,
) -> DataFrame:
    """Aggregate ``right_daily`` over the days ``left_day + lo .. left_day + hi``.

    ``right_daily`` holds one row per key and day, so a key never has more rows than
    the period has days and the window stays small for the busiest key. ``None``
    leaves an end open. The left rows themselves only meet the result in an equi-join
    with unique right keys. Left rows with no right row in range get nulls.
    """
    keys = list(on)
    points = left.select(*keys, F.col(left_day).alias("_day")).where(_all_present([*keys, "_day"])).distinct()
    known = right_daily.withColumn("_day", F.col(right_day)).where(_all_present([*keys, "_day"]))
    both = points.withColumn("_ask", F.lit(True)).unionByName(known, allowMissingColumns=True)
    frame = (
        W.partitionBy(*keys)
        .orderBy(F.unix_date("_day"))
        .rangeBetween(W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)
    )
    answers = both.select(*keys, "_day", "_ask", *[m.over(frame).alias(n) for n, m in measures.items()]).where("_ask").drop("_ask")
    return left.join(answers.withColumnRenamed("_day", left_day), [*keys, left_day], "left").select(*left.columns, *measures)
