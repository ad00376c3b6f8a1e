"""Checks of the reports against the logs they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from ..operators.attribution import credit_last, sessions_after


def avg_time_per_user(
    exposures: DataFrame,
    usage: DataFrame,
    on: Sequence[str] = ("device_id", "country"),
    keys: Sequence[str] = ("country", "creative_id", "campaign_id"),
    tiebreak: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Per creative: impressions, reach, (exposure, later session) pairs, openers, and
    time credited to the last exposure, in total and per opener.

    The pairs are counted from running totals and never formed.
    """
    shown = exposures.groupBy(*keys, "device_id").agg(F.count(F.lit(1)).alias("_n"))
    delivered = shown.groupBy(*keys).agg(F.sum("_n").alias("impressions"), F.count("device_id").alias("reach"))
    followed = sessions_after(exposures, usage, on).groupBy(*keys, "device_id").agg(F.sum("sessions_after").alias("_n"))
    opens = followed.groupBy(*keys).agg(F.sum("_n").alias("opens_any_touch"), F.count("device_id").alias("openers"))
    carry = [k for k in keys if k not in on]
    credited = credit_last(exposures, usage, on, carry=carry, tiebreak=tiebreak)
    time = credited.groupBy(*[k for k in keys if k in on], *[F.col(f"hit.{c}").alias(c) for c in carry]).agg(F.sum("minutes").alias("minutes"))
    out = opens.join(delivered, list(keys)).join(time, list(keys), "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))
    return out.withColumn("hours", F.round(F.col("minutes") / 60, 2)).withColumn("minutes_per_opener", ratio("minutes", "openers"))


def reconcile(
    exposures: DataFrame,
    usage: DataFrame,
    on: Sequence[str] = ("device_id", "country"),
    carry: Sequence[str] = ("creative_id", "campaign_id"),
    tiebreak: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Raw against credited minutes per device: credit never exceeds the raw time."""
    raw = usage.where(F.col("device_id").isNotNull()).groupBy("device_id").agg(F.sum("minutes").alias("raw_minutes"), F.count(F.lit(1)).alias("sessions"))
    credited = credit_last(exposures, usage, on, carry=carry, tiebreak=tiebreak)
    given = credited.groupBy("device_id").agg(F.sum("minutes").alias("credited_minutes"), F.count(F.lit(1)).alias("credited_sessions"))
    out = raw.join(given, "device_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("credited_minutes", "credited_sessions")]
    return out.select("device_id", "raw_minutes", "sessions", *zero).withColumn("difference", F.col("raw_minutes") - F.col("credited_minutes"))


def compare_totals(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], measure: str, tolerance: float = 0.02) -> DataFrame:
    """A measure from two sources side by side, with the relative gap."""
    other = theirs.select(*keys, F.col(measure).alias("reported"))
    both = ours.select(*keys, F.col(measure).alias("measured")).join(other, list(keys))
    gap = F.abs(ratio(F.col("measured") - F.col("reported"), F.col("reported")))
    return both.withColumn("gap", gap).withColumn("within", F.col("gap") <= tolerance)
