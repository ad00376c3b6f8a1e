"""Which exposure gets credit for a conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import day
from .asof import SLICE_SECONDS, asof, day_lookup
from .rows import keep


def attribute(
    exposures: DataFrame,
    conversions: DataFrame,
    on: Sequence[str],
    touch: str = "last",
    window_days: int | None = 7,
    exposure_ts: str = "event_ts",
    conversion_ts: str = "conversion_ts",
    carry: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    grain: str = "instant",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Conversions with the one exposure that gets credit, in the struct ``hit``.

    The exposure has the same key, is not later than the conversion and lies at most
    ``window_days`` calendar days before it (``None``: any time before). ``touch``
    picks the last or the first of them; ``grain="day"`` compares days instead of
    instants. Conversions without such an exposure are left out. Ties go to the
    largest tiebreak for last touch, to the smallest for first touch.
    """
    if grain == "instant" and touch == "last":
        found = asof(conversions, exposures, on, conversion_ts, exposure_ts, carry, tiebreak, slice_seconds=slice_seconds)
        if window_days is not None:
            found = found.where(F.datediff(conversion_ts, "hit.ts") <= window_days)
        return found

    # First touch, and either touch by day, need one exposure per key and day: the
    # earliest exposure of the window is the earliest of one of its days.
    pick = F.max if touch == "last" else F.min
    when = F.col(exposure_ts) if grain == "instant" else day(exposure_ts)
    hit = F.struct(when.alias("ts"), *tiebreak, *[c for c in carry if c not in tiebreak])
    daily = exposures.groupBy(*on, day(exposure_ts).alias("_exposed_on")).agg(pick(hit).alias("_best"))
    dated = conversions.withColumn("_converted_on", day(conversion_ts))
    found = day_lookup(
        dated, daily, on, "_converted_on", "_exposed_on", {"hit": pick("_best")}, None if window_days is None else -window_days, 0
    ).drop("_converted_on")
    if grain == "instant":
        return found.where(F.col("hit.ts") <= F.col(conversion_ts))
    return found.where(F.col("hit").isNotNull())


def distinct_exposure_days(exposures: DataFrame, keys: Sequence[str], ts: str = "event_ts") -> DataFrame:
    """Day-grain exposure log: equal days merge, as a distinct union of logs does."""
    return exposures.select(*keys, day(ts).alias("expose_date")).distinct()


def daily_usage(usage: DataFrame, on: Sequence[str], ts: str = "conversion_ts", minutes: str = "minutes") -> DataFrame:
    """Time and number of sessions per key and day."""
    return usage.groupBy(*on, day(ts).alias("usage_date")).agg(
        F.sum(minutes).alias("minutes"), F.count(F.lit(1)).alias("sessions")
    )


def any_touch(
    exposures: DataFrame,
    usage: DataFrame,
    on: Sequence[str],
    window_days: int | None = 14,
    exposure_keys: Sequence[str] = ("creative_id", "campaign_id"),
    exposure_ts: str = "event_ts",
    usage_ts: str = "conversion_ts",
    minutes: str = "minutes",
) -> DataFrame:
    """Every exposure day that usage follows within the window, per device.

    ``minutes`` is all later time of the device (not only inside the window), equal
    session lengths counted once, and is repeated for every exposure: it adds up to
    more than the time spent. ``credit_once`` does not.
    """
    shown = distinct_exposure_days(exposures, [*on, *exposure_keys], exposure_ts)
    days = usage.groupBy(*on, day(usage_ts).alias("usage_date")).agg(F.count(F.lit(1)).alias("_n"))
    # a length counts for an exposure day when its last occurrence is not earlier
    lengths = usage.groupBy(*on, minutes).agg(F.max(day(usage_ts)).alias("usage_date"))
    later = lengths.groupBy(*on, "usage_date").agg(F.sum(minutes).alias("_minutes"))
    opened = day_lookup(shown, days, on, "expose_date", "usage_date", {"_n": F.sum("_n")}, 0, window_days)
    opened = opened.where(F.col("_n") > 0).drop("_n")
    return day_lookup(opened, later, on, "expose_date", "usage_date", {"minutes": F.sum("_minutes")}, 0, None)


def any_touch_by_day(opened: DataFrame, on_device: str = "device_id", keys: Sequence[str] = ("country", "expose_date", "creative_id", "campaign_id")) -> DataFrame:
    """Openers and (repeated) time per exposure day and creative."""
    return opened.groupBy(*keys).agg(
        F.countDistinct(on_device).alias("openers"), F.sum("minutes").alias("minutes")
    )


def credit_once(
    exposures: DataFrame,
    usage: DataFrame,
    on: Sequence[str],
    window_days: int = 14,
    exposure_keys: Sequence[str] = ("creative_id", "campaign_id"),
    exposure_ts: str = "event_ts",
    usage_ts: str = "conversion_ts",
    minutes: str = "minutes",
) -> DataFrame:
    """Time of the sessions that follow an exposure within the window, each session once
    per device and ``exposure_keys`` however many exposures precede it.

    The days one exposure adds to those already covered by the previous exposure form
    an interval, and the time inside it is a difference of two running totals.
    """
    shown = distinct_exposure_days(exposures, [*on, *exposure_keys], exposure_ts)
    prev = F.lag("expose_date").over(W.partitionBy(*on, *exposure_keys).orderBy("expose_date"))
    before_first = F.greatest(F.date_sub("expose_date", 1), F.date_add("_prev", window_days))
    ends = shown.withColumn("_prev", prev).select(
        *on,
        *exposure_keys,
        F.explode(
            F.array(
                F.struct(F.date_add("expose_date", window_days).alias("d"), F.lit(1).alias("sign")),
                F.struct(before_first.alias("d"), F.lit(-1).alias("sign")),
            )
        ).alias("p"),
    ).select(*on, *exposure_keys, F.col("p.d").alias("_on_day"), F.col("p.sign").alias("_sign"))
    totals = daily_usage(usage, on, usage_ts, minutes)
    running = day_lookup(
        ends, totals, on, "_on_day", "usage_date", {"_minutes": F.sum("minutes"), "_sessions": F.sum("sessions")}, None, 0
    )
    signed = lambda c: F.coalesce(F.sum(F.col("_sign") * F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    return (
        running.groupBy(*on, *exposure_keys)
        .agg(signed("_minutes").alias("minutes"), signed("_sessions").alias("sessions"))
        .where(F.col("sessions") > 0)
    )


def credit_last(
    exposures: DataFrame,
    sessions: DataFrame,
    on: Sequence[str],
    exposure_ts: str = "event_ts",
    session_ts: str = "conversion_ts",
    carry: Sequence[str] = ("creative_id", "campaign_id"),
    tiebreak: Sequence[str] = (),
    window_days: int | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Each session credited once overall, to the last exposure before it."""
    return attribute(
        exposures, sessions, on, "last", window_days, exposure_ts, session_ts, carry, tiebreak, slice_seconds=slice_seconds
    )


def sessions_after(
    exposures: DataFrame,
    sessions: DataFrame,
    on: Sequence[str],
    exposure_ts: str = "event_ts",
    session_ts: str = "conversion_ts",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Exposures followed by at least one session, with the number that follow."""
    return asof(
        exposures, sessions, on, exposure_ts, session_ts, sums={"sessions_after": F.lit(1)}, direction="forward", slice_seconds=slice_seconds
    ).drop("hit")


def first_use(usage: DataFrame, keys: Sequence[str], ts: str = "conversion_ts", name: str = "first_ts") -> DataFrame:
    """First use in the look-back, per key (an install proxy)."""
    return usage.groupBy(*keys).agg(F.min(ts).alias(name))


def nearest_exposure(
    exposures: DataFrame,
    first_opens: DataFrame,
    device: str = "device_id",
    exposure_ts: str = "event_ts",
    open_ts: str = "first_ts",
    carry: Sequence[str] = (),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """One row per device: the exposure with the fewest seconds to a first open, the
    earlier exposure (then the earlier open) when several are equally near."""
    second = F.unix_timestamp(exposure_ts)
    per_second = (
        exposures.groupBy(device, second.alias("_second"))
        .agg(F.min(F.struct(exposure_ts, *carry)).alias("_first"))
        .select(device, "_first.*")
    )
    near = asof(first_opens, per_second, [device], open_ts, exposure_ts, carry=carry, slice_seconds=slice_seconds)
    gap = F.unix_timestamp(open_ts) - F.unix_timestamp("hit.ts")
    best = near.groupBy(device).agg(F.min(F.struct(gap.alias("gap_seconds"), F.col("hit"), F.col(open_ts))).alias("_b"))
    return best.select(device, "_b.gap_seconds", F.col("_b.hit.ts").alias(exposure_ts), f"_b.{open_ts}", *[F.col(f"_b.hit.{c}").alias(c) for c in carry])


def conversion_matrix(
    exposures: DataFrame,
    usage: DataFrame,
    device: str = "device_id",
    window_days: int = 30,
    exposure_ts: str = "event_ts",
    usage_ts: str = "conversion_ts",
    carry: Sequence[str] = ("product",),
    tiebreak: Sequence[str] = (),
) -> dict[tuple[str, str], DataFrame]:
    """First or last touch, for the first use or for all use of a device: four tables."""
    exposures = keep(exposures.select(device, exposure_ts, *dict.fromkeys([*tiebreak, *carry])))
    usage = keep(usage)
    firsts = first_use(usage, [device], usage_ts, usage_ts)
    out = {}
    for touch in ("first", "last"):
        for scope, conversions in (("first_use", firsts), ("all_use", usage)):
            found = attribute(exposures, conversions, [device], touch, window_days, exposure_ts, usage_ts, carry, tiebreak)
            out[touch, scope] = found.withColumn("days_to_convert", F.datediff(usage_ts, "hit.ts"))
    return out
