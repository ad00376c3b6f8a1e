"""Device universes: who could have been exposed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_ts, ts_lit
from ..functions.predicates import not_dropped
from .rows import attach_device, audience_or, exclude, semi

# Sellers whose deliveries identify devices directly, and the
# exchange and seller of owned-and-operated inventory.
KNOWN_SELLERS = ("86", "88", "1", "256027", "237147", "escg8-6k2bc", "amgyk-mxvjr")
OWN_EXCHANGE = 6
OWN_SELLER = "86"


def qualify_universe_start(
    impressions: DataFrame, start: datetime, sellers: Sequence[str] = KNOWN_SELLERS, extra_days: int = 30
) -> DataFrame:
    """One row: the universe starts ``extra_days`` earlier when none of the known
    sellers delivered, also when nothing was delivered at all."""
    seen = F.sort_array(F.collect_set(F.concat(F.lit('"'), F.col("exchange_seller_id").cast("string"), F.lit('"'))))
    # sellers are few; one row per seller reaches the list
    per_seller = impressions.select("exchange_seller_id").distinct()
    listed = per_seller.agg(F.array_join(seen, ",").alias("seller_list"))
    known = F.arrays_overlap(F.split("seller_list", ","), F.array(*[F.lit(f'"{s}"') for s in sellers]))
    earlier = datetime(start.year, start.month, start.day) - timedelta(days=extra_days)
    extend = ~known
    return listed.select(
        "seller_list",
        F.when(extend, f"Superset +{extra_days} days").otherwise("Superset").alias("qualifier"),
        F.when(extend, ts_lit(earlier)).otherwise(ts_lit(start)).alias("universe_start"),
    )


def universe(hardware: DataFrame, deliveries: DataFrame, opened: DataFrame, profile_map: DataFrame) -> DataFrame:
    """Distinct devices seen as hardware, in owned-and-operated impressions or opening
    an app. Each source is reduced to distinct devices before the union."""
    own = deliveries.where(
        (F.col("event_type") == "impression")
        & not_dropped()
        & ((F.col("exchange_id") == OWN_EXCHANGE) | (F.col("exchange_seller_id").cast("string") == OWN_SELLER))
    )
    by_profile = lambda df: attach_device(df.select("profile_id").distinct(), profile_map, "inner").select("device_id")
    return audience_or(by_profile(hardware), own.select("device_id"), by_profile(opened))


def mini_universe(devices: DataFrame, usage: DataFrame, blackout: tuple[datetime, datetime]) -> DataFrame:
    """Universe without devices that used the app in the blackout window."""
    return exclude(devices, usage.where(between_ts("conversion_ts", *blackout)), "device_id")


def exposures_in_universe(
    impressions: DataFrame,
    campaigns: DataFrame,
    devices: DataFrame,
    campaign_keys: Sequence[str] = ("campaign_id",),
    count_by: Sequence[str] = (),
) -> DataFrame:
    """Impressions of the campaigns on universe devices, as rows or counted."""
    found = semi(impressions.join(campaigns, list(campaign_keys)), devices, ["device_id"])
    if count_by:
        return found.groupBy(*count_by).agg(F.count(F.lit(1)).alias("impressions"))
    return found


def ad_tier_usage(usage: DataFrame, ad_evidence: DataFrame) -> DataFrame:
    """Usage by profiles that were served in-app ads."""
    return semi(usage, ad_evidence, ["profile_id"])


def in_app_ads(ad_exposures: DataFrame, ad_meta: DataFrame) -> DataFrame:
    """In-app ad exposures with advertiser data; unknown ads keep nulls."""
    return ad_exposures.join(ad_meta, "ad_id", "left")


def quadrants(devices: DataFrame, exposed: DataFrame, converted: DataFrame) -> DataFrame:
    """Devices by exposed / converted; the four cells add up to the universe.

    One outer pass per flag instead of four semi- and anti-joins."""
    flag = lambda df, name: df.select("device_id").where(F.col("device_id").isNotNull()).distinct().withColumn(name, F.lit(True))
    base = devices.select("device_id").where(F.col("device_id").isNotNull()).distinct()
    both = base.join(flag(exposed, "_e"), "device_id", "left").join(flag(converted, "_c"), "device_id", "left")
    e, c = F.col("_e").isNotNull(), F.col("_c").isNotNull()
    return both.agg(
        F.count_if(e & c).alias("exposed_converted"),
        F.count_if(e & ~c).alias("exposed_unconverted"),
        F.count_if(~e & c).alias("unexposed_converted"),
        F.count_if(~e & ~c).alias("unexposed_unconverted"),
        F.count(F.lit(1)).alias("universe"),
    )
