"""Row selection, set operations and joins shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], ascending: bool = False) -> DataFrame:
    """Latest (or earliest) version of each key. ``order`` ends in a unique column.

    ``row_number() = 1`` lets Spark keep one row per key and input partition before the
    shuffle, so a key with very many versions costs one row per partition.
    """
    by = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in order]
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def semi(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """``IN (SELECT DISTINCT ...)``. The list is really made distinct: a key that fills it
    shrinks to one row per partition before the shuffle, and a busy left key can be split."""
    return df.join(wanted.select(*on).distinct(), list(on), "left_semi")


def exclude(df: DataFrame, unwanted: DataFrame, on: str) -> DataFrame:
    """``NOT IN`` with nulls removed from the list: rows with a null key go too."""
    listed = unwanted.where(F.col(on).isNotNull()).select(on).distinct()
    return df.where(F.col(on).isNotNull()).join(listed, on, "left_anti")


def attach_device(df: DataFrame, profile_map: DataFrame, how: str = "left") -> DataFrame:
    """Add ``device_id`` by profile. ``left`` keeps profiles without a device (null)."""
    return df.join(profile_map.select("profile_id", "device_id"), "profile_id", how)


def audience_or(*audiences: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, audiences).distinct()


def audience_and(*audiences: DataFrame) -> DataFrame:
    """Ids present in every audience: one shuffle, whatever the number of lists."""
    column = audiences[0].columns[0]
    tagged = reduce(
        DataFrame.union, (a.select(column, F.lit(1 << i).cast("bigint").alias("_list")) for i, a in enumerate(audiences))
    )
    seen = tagged.where(F.col(column).isNotNull()).groupBy(column).agg(F.bit_or("_list").alias("_in"))
    return seen.where(F.col("_in") == (1 << len(audiences)) - 1).select(column)


def match_any_pattern(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose text matches at least one of the LIKE patterns, any case. Patterns are
    parameters of a report, so they become one predicate and no join."""
    return df.where(reduce(lambda a, b: a | b, (F.ilike(F.col(column), F.lit(p)) for p in patterns), F.lit(False)))


def ensure_one_row(df: DataFrame, **constants: Column) -> DataFrame:
    """Put constant columns in front; an empty input still yields one (blank) row."""
    one = df.sparkSession.range(1).select(F.lit(True).alias("_one"), *[c.alias(n) for n, c in constants.items()])
    filled = one.join(df.drop(*constants).withColumn("_one", F.lit(True)), "_one", "left")
    return filled.select(*constants, *[c for c in df.columns if c not in constants])


#: Levels of aligned nodes: 2^40 bins are longer than any log.
LEVELS = 40


def dyadic_nodes(first: Column, last: Column) -> Column:
    """Aligned nodes (``level``, ``node``) that exactly cover the bins ``first`` to ``last``.

    A node of level k stands for 2^k bins. At each level at most two are left over, one
    at each end, so there are at most about twice as many as the length has digits.
    """
    one = F.lit(1).cast("bigint")

    def ends(level):
        shift = lambda n: F.call_function("shiftright", n, level)
        # whole nodes of this level inside the bins: from ``low`` to before ``high``
        low, high = shift(first + F.call_function("shiftleft", one, level) - 1), shift(last + 1)
        odd = lambda n: n.bitwiseAND(one) == 1
        left = F.when((low < high) & odd(low), F.struct(level.alias("level"), low.alias("node")))
        right = F.when((low < high) & odd(high), F.struct(level.alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    return F.filter(F.flatten(F.transform(levels, ends)), lambda n: n.isNotNull())


def contained_in(
    inner: DataFrame,
    outer: DataFrame,
    on: Sequence[str],
    inner_span: tuple[str, str],
    outer_span: tuple[str, str],
    bin_seconds: int = 3600,
) -> DataFrame:
    """Pairs where the inner interval lies inside the outer one.

    An outer interval is cut into aligned nodes, some 40 for one of 24 years, and the
    start of an inner one looks up its ancestors at the levels that outer intervals use.
    The join key is (key, level, node), so each pair is found exactly once and a busy
    key is spread over its nodes.
    """
    (i0, i1), (o0, o1) = inner_span, outer_span
    bin_of = lambda c: F.floor(F.unix_timestamp(c) / bin_seconds)
    spread = outer.where(F.col(o1) >= F.col(o0)).withColumn("_n", F.explode(dyadic_nodes(bin_of(o0), bin_of(o1))))
    spread = spread.withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = spread.select("_level").distinct()  # at most LEVELS rows
    placed = inner.crossJoin(F.broadcast(levels)).withColumn("_node", F.call_function("shiftright", bin_of(i0), F.col("_level")))
    found = placed.join(spread, [*on, "_level", "_node"]).drop("_level", "_node")
    return found.where((F.col(i0) >= F.col(o0)) & (F.col(i1) <= F.col(o1)))


def first_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """Add the value of the first row of each key, in the order of ``order`` (which ends in
    a unique column). It is aggregated and joined back: no key is gathered into a task."""
    firsts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(value, F.struct(*order)).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(firsts, same, "left").select(*df.columns, name)


def ratio_to_report(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Share of the total, per ``keys`` or overall. Totals are aggregated and joined
    back, so the detail rows are never gathered into one task."""
    total = F.sum(column).alias("_total")
    part = F.try_divide(F.col(column).cast("double"), F.col("_total"))
    if keys:
        both = df.join(df.groupBy(*keys).agg(total), list(keys))
    else:
        both = df.crossJoin(F.broadcast(df.agg(total)))
    return both.withColumn(name, part).drop("_total")


def keep(df: DataFrame) -> DataFrame:
    """Hold a stage that several later stages read. Lost blocks are recomputed, blocks
    that do not fit in memory go to disk; ``spark.catalog.clearCache()`` lets go."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
