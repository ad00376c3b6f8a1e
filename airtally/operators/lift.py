"""Exposed against unexposed conversion rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.metrics import freq_bucket, ratio
from .rows import semi


def overall_lift(devices: DataFrame, mini: DataFrame, exposures: DataFrame, converted: DataFrame, exposed_converted: DataFrame) -> DataFrame:
    """Reach, frequency, conversion rates and lift as one row.

    Rates are taken within the mini-universe; ``exposed_converted`` are the devices
    credited by attribution.
    """
    shown = semi(exposures, mini, ["device_id"]).agg(
        F.countDistinct("device_id").alias("reach"), F.count(F.lit(1)).alias("imps")
    )
    sizes = devices.agg(F.countDistinct("device_id").alias("universe"))
    mini_size = mini.agg(F.countDistinct("device_id").alias("mini_universe"))
    all_converted = semi(mini, converted, ["device_id"]).agg(F.countDistinct("device_id").alias("_conv"))
    exp = exposed_converted.agg(F.countDistinct("device_id").alias("exposed_conversions"))
    one = sizes
    for part in (mini_size, shown, all_converted, exp):
        one = one.crossJoin(F.broadcast(part))  # each side is a single row
    one = one.select(
        "universe",
        "mini_universe",
        "imps",
        "reach",
        ratio("imps", "reach").alias("frequency"),
        "exposed_conversions",
        ratio("exposed_conversions", "reach").alias("exposed_rate"),
        (F.col("mini_universe") - F.col("reach")).alias("unexposed"),
        (F.col("_conv") - F.col("exposed_conversions")).alias("unexposed_conversions"),
    )
    one = one.withColumn("unexposed_rate", ratio("unexposed_conversions", "unexposed"))
    return one.withColumn("lift", ratio("exposed_rate", "unexposed_rate") - 1)


def device_imps(exposures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Impressions per device (and key); everything below works on this aggregate."""
    return exposures.groupBy("country", "device_id", *keys).agg(F.count(F.lit(1)).alias("imps"))


def lift_by(
    exposures: DataFrame,
    audience_usage: DataFrame,
    devices: DataFrame,
    by: Sequence[str] = (),
    frequency_cap: int | None = None,
    hours: bool = True,
) -> DataFrame:
    """Lift per placement, creative, flight or frequency bucket (or overall).

    ``audience_usage`` is the usage of the matched audience with ``hours``;
    a device exposed to a key at any time counts as exposed. ``devices`` has the
    country of each device, as every country is measured against its own universe.
    """
    per_device = device_imps(exposures, by)
    keys = ["country", *by]
    if frequency_cap:
        per_device = per_device.withColumn("frequency", freq_bucket("imps", frequency_cap))
        keys = [*keys, "frequency"]
    used = audience_usage.where(F.col("device_id").isNotNull()).groupBy("country", "device_id").agg(F.sum("hours").alias("_hours"))
    # one pass: each exposed device carries its impressions and, if any, its usage
    both = per_device.join(used.withColumn("_used", F.lit(1)), ["country", "device_id"], "left")
    exposed = both.groupBy(*keys).agg(
        F.count("device_id").alias("reach"),
        F.sum("imps").alias("imps"),
        F.count(F.when(F.col("_used") == 1, F.col("device_id"))).alias("exposed_users"),
        F.sum("_hours").alias("exposed_hours"),
    ).where(F.col("exposed_users") > 0)
    totals = used.groupBy("country").agg(F.count("device_id").alias("total_users"), F.sum("_hours").alias("total_hours"))
    out = exposed.join(totals, "country").join(universe_size(devices), "country")
    out = (
        out.withColumn("frequency_avg", ratio("imps", "reach"))
        .withColumn("unexposed", F.col("universe") - F.col("reach"))
        .withColumn("unexposed_users", F.col("total_users") - F.col("exposed_users"))
        .withColumn("exposed_rate", ratio("exposed_users", "reach"))
        .withColumn("unexposed_rate", ratio("unexposed_users", "unexposed"))
        .withColumn("lift", ratio("exposed_rate", "unexposed_rate") - 1)
    )
    if not hours:
        return out.drop("exposed_hours", "total_hours")
    return (
        out.withColumn("unexposed_hours", F.col("total_hours") - F.col("exposed_hours"))
        .withColumn("avg_exposed_hours", ratio("exposed_hours", "exposed_users"))
        .withColumn("avg_unexposed_hours", ratio("unexposed_hours", "unexposed_users"))
        .withColumn("lift_hours", ratio("avg_exposed_hours", "avg_unexposed_hours") - 1)
    )


def universe_size(devices: DataFrame) -> DataFrame:
    """Distinct devices of each country."""
    return devices.groupBy("country").agg(F.countDistinct("device_id").alias("universe"))


def daily_exposure(exposures: DataFrame, audience_usage: DataFrame, devices: DataFrame) -> DataFrame:
    """Reach, impressions, app users and users exposed the same day, per country and day."""
    keys = ["country", "date"]
    shown = exposures.groupBy("country", "device_id", day("event_ts").alias("date")).agg(F.count(F.lit(1)).alias("imps"))
    used = audience_usage.select("country", "device_id", day("conversion_ts").alias("date")).distinct()
    delivered = shown.groupBy(*keys).agg(F.count("device_id").alias("reach"), F.sum("imps").alias("imps"))
    users = used.groupBy(*keys).agg(F.count("device_id").alias("total_users"))
    exposed = semi(used, shown, [*keys, "device_id"]).groupBy(*keys).agg(F.count("device_id").alias("exposed_users"))
    out = users.join(delivered, keys).join(exposed, keys).join(universe_size(devices), "country")
    return out.withColumn("unexposed", F.col("universe") - F.col("reach")).withColumn(
        "unexposed_users", F.col("total_users") - F.col("exposed_users")
    )


def matched_audience(devices: DataFrame, audience: DataFrame) -> DataFrame:
    """Devices of a first-party list that belong to the universe."""
    return semi(devices, audience, ["device_id"]).distinct()


def matched_usage(usage: DataFrame, matched: DataFrame) -> DataFrame:
    return semi(usage, matched, ["device_id"])


def matched_counts(audience: DataFrame, matched_use: DataFrame) -> DataFrame:
    """Size of the list beside the number of its devices that used the app."""
    listed = audience.agg(F.countDistinct("device_id").alias("audience_size"))
    used = matched_use.agg(F.countDistinct("device_id").alias("matched_users"))
    return listed.crossJoin(F.broadcast(used))  # one row each
