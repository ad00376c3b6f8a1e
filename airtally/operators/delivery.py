"""Ad delivery log: splitting, counting, reach, video progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.metrics import VIDEO_TILES
from ..functions.predicates import not_dropped

CREATIVE_KEYS = ("country", "campaign_id", "flight_id", "creative_id")


def first_device(df: DataFrame, ids: str = "device_ids") -> DataFrame:
    """First id of the event's device list; null when the list is empty."""
    return df.withColumn("device_id", F.get(F.col(ids), F.lit(0)))


def split_delivery(df: DataFrame, drop_clicks_too: bool = True) -> dict[str, DataFrame]:
    """One log into impressions, clicks, trackers and pixels, dropped events removed
    (``drop_clicks_too=False`` leaves clicks as they are)."""
    kept = df.where(not_dropped())
    of = lambda frame, kind: frame.where(F.col("event_type") == kind)
    return {
        "impressions": of(kept, "impression"),
        "clicks": of(kept if drop_clicks_too else df, "click"),
        "tracker": of(kept, "tracker"),
        "pixels": of(kept, "segment"),
    }


def in_creative_map(df: DataFrame, creative_map: DataFrame, line_fanout: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Events of mapped (country, campaign, flight, creative). With ``line_fanout`` an
    event is repeated for every line that carries its creative."""
    columns = [*CREATIVE_KEYS, *(("line_item_id", *extra) if line_fanout else ())]
    return df.join(creative_map.select(*columns).distinct(), list(CREATIVE_KEYS), "inner")


def delivery_stats(df: DataFrame, name: str, keys: Sequence[str] = CREATIVE_KEYS, count_devices_only: bool = False) -> DataFrame:
    """Events per day and creative; ``count_devices_only`` skips events without a device."""
    counted = F.count("device_id") if count_devices_only else F.count(F.lit(1))
    return df.groupBy(day("event_ts").alias("date_of_exposure"), *keys).agg(counted.alias(name))


def reach(df: DataFrame, keys: Sequence[str] = CREATIVE_KEYS, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(day("event_ts").alias("date_of_exposure"), *keys).agg(distinct("device_id").alias("reach"))


def impressions_and_reach(df: DataFrame, keys: Sequence[str] = CREATIVE_KEYS) -> DataFrame:
    """Both counts from one shuffle of (day, creative, device) totals."""
    per_device = df.groupBy(day("event_ts").alias("date_of_exposure"), *keys, "device_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_device.groupBy("date_of_exposure", *keys).agg(
        F.sum("_n").alias("impressions"), F.count("device_id").alias("reach")
    )


def video_tiles(tracker: DataFrame, keys: Sequence[str] = CREATIVE_KEYS) -> DataFrame:
    """Starts, quartiles and completions per day and creative; null when there was none."""
    return tracker.groupBy(day("event_ts").alias("date_of_exposure"), *keys).agg(
        *[F.sum(F.when(F.col("tracker").isin(*names), 1)).alias(tile) for tile, names in VIDEO_TILES.items()]
    )


def imps_and_clicks(impressions: DataFrame, clicks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Impressions with the clicks of the same day and keys. A day with clicks only is
    left out: impressions drive the report. Equal log rows count once."""
    dated = lambda df: df.select(*keys, "device_id", "event_ts").distinct().groupBy(day("event_ts").alias("date"), *keys)
    shown = dated(impressions).agg(F.count(F.lit(1)).alias("impressions"))
    clicked = dated(clicks).agg(F.count(F.lit(1)).alias("clicks"))
    return shown.join(clicked, ["date", *keys], "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))


def adhoc_counts(impressions: DataFrame, usage: DataFrame, creative_ids: Sequence) -> DataFrame:
    """Impressions of a list of creatives beside the distinct users of a look-back."""
    shown = impressions.where(F.col("creative_id").isin(*creative_ids)).agg(F.count(F.lit(1)).alias("impressions"))
    users = usage.agg(F.countDistinct("device_id").alias("app_users"))
    return shown.crossJoin(F.broadcast(users))


def device_spread(exposures: DataFrame, first_opens: DataFrame, on: Sequence[str], min_days: int = 7, first: str = "first_ts") -> DataFrame:
    """Devices first exposed no later than their first open and exposed again at least
    ``min_days`` days after the first exposure."""
    span = exposures.groupBy(*on).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.min(day("event_ts")).alias("first_exposure"),
        F.max(day("event_ts")).alias("last_exposure"),
    )
    opened = first_opens.select(*on, day(first).alias("first_open"))
    return span.join(opened, list(on)).where(
        (F.datediff("last_exposure", "first_exposure") >= min_days) & (F.col("first_exposure") <= F.col("first_open"))
    )
