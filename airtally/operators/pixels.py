"""Web pixels: households, page visits and their attribution."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_ts, day
from ..functions.predicates import id_in, not_dropped
from .attribution import attribute, first_use
from .rows import keep, latest_per_key, semi


def household_map(delivery: DataFrame, profile_map: DataFrame, tiebreak: Sequence[str] = ("event_id",)) -> DataFrame:
    """Last device seen per household, with a profile of that device.

    The log is reduced to one row per household before it meets the map; only devices
    the map knows count as seen.
    """
    kept = delivery.where(not_dropped() & F.col("event_type").isin("impression", "click") & F.col("household_id").isNotNull())
    known = semi(kept, profile_map, ["device_id"])
    last = latest_per_key(known.select("household_id", "device_id", "event_ts", *tiebreak), ["household_id"], ["event_ts", *tiebreak])
    one_profile = profile_map.groupBy("device_id").agg(F.min("profile_id").alias("profile_id"))
    return last.select("household_id", "device_id").join(one_profile, "device_id")


def pixel_visits(delivery: DataFrame, households: DataFrame, segments: Sequence, window: tuple[datetime, datetime]) -> DataFrame:
    """Pixel events of known households and wanted segments; blank segments select nothing."""
    pixels = delivery.where(
        (F.col("event_type") == "segment") & not_dropped() & id_in("segment_id", segments) & between_ts("event_ts", *window)
    ).select("household_id", "country", "segment_id", F.col("event_ts").alias("conversion_ts"))
    return pixels.join(households.select("household_id", "device_id"), "household_id")


def first_visits(visits: DataFrame, keys: Sequence[str] = ("household_id", "country", "segment_id")) -> DataFrame:
    return first_use(visits, keys)


def first_visits_by_day(visits: DataFrame, device: str = "device_id") -> DataFrame:
    """Devices by segment and day of their first visit."""
    firsts = first_use(visits, [device, "segment_id"])
    return firsts.groupBy(day("first_ts").alias("date"), "segment_id").agg(F.count(device).alias("visits"))


def visits_by_day(visits: DataFrame, segments: dict[str, str]) -> DataFrame:
    """Distinct households per day and country, one column per named segment."""
    return visits.groupBy(day("conversion_ts").alias("date_of_exposure"), "country").agg(
        *[
            F.countDistinct(F.when(F.col("segment_id").cast("string") == segment, F.col("household_id"))).alias(name)
            for name, segment in segments.items()
        ]
    )


def exposed_visits(
    impressions: DataFrame,
    visits: DataFrame,
    window_days: int = 7,
    carry: Sequence[str] = ("campaign_id", "flight_id", "creative_id"),
    tiebreak: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Last touch per household and country. ``is_first`` marks the first visit to the
    segment, so that first visits need no attribution of their own. Visits at the same
    instant count once."""
    keys = ["household_id", "country", "segment_id"]
    once = visits.select(*keys, "conversion_ts").distinct()
    marked = once.join(first_visits(once, keys), keys).withColumn("is_first", F.col("conversion_ts") == F.col("first_ts")).drop("first_ts")
    marked = keep(marked)
    return attribute(impressions, marked, ["household_id", "country"], "last", window_days, carry=carry, tiebreak=tiebreak)


def exposed_visits_any(
    exposures: DataFrame, visits: DataFrame, keys: Sequence[str] = ("creative_name", "placement_name"), device: str = "device_id", first_only: bool = False
) -> DataFrame:
    """Devices per visit day, segment and creative, exposed to it at any earlier time.

    A device counts on a day when its first exposure to the creative is not later than
    its last visit of that day, so one row per device and creative meets one row per
    device, segment and day.
    """
    shown = exposures.groupBy(device, *keys).agg(F.min("event_ts").alias("_first_shown"))
    if first_only:
        seen = visits.groupBy(device, "segment_id").agg(F.min("conversion_ts").alias("_last_visit")).withColumn("date", day("_last_visit"))
    else:
        seen = visits.groupBy(device, "segment_id", day("conversion_ts").alias("date")).agg(F.max("conversion_ts").alias("_last_visit"))
    met = shown.join(seen, device).where(F.col("_first_shown") <= F.col("_last_visit"))
    return met.groupBy("date", "segment_id", *keys).agg(F.countDistinct(device).alias("visitors"))
