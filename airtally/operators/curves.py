"""How long and how many exposures until a conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import diff
from ..functions.metrics import ttc_bucket
from .asof import SLICE_SECONDS, asof
from .rows import keep


def exposures_to_convert(
    exposures: DataFrame,
    conversions: DataFrame,
    window_days: int = 7,
    device: str = "device_id",
    placement: str = "placement",
    exposure_ts: str = "event_ts",
    conversion_ts: str = "conversion_ts",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Per device and placement: first exposure, first conversion it led to, distinct
    exposure times up to then and seconds between the two.

    Each exposure leads to the next conversion of its device. Later exposures lead to
    later conversions, so the exposures that precede the first conversion are exactly
    those that lead to it.
    """
    shown = exposures.select(device, placement, exposure_ts).distinct()
    led = asof(shown, conversions, [device], exposure_ts, conversion_ts, direction="forward", slice_seconds=slice_seconds)
    led = led.where(F.datediff("hit.ts", exposure_ts) <= window_days)
    per_conversion = led.groupBy(device, placement, F.col("hit.ts").alias("_converted")).agg(
        F.count(F.lit(1)).alias("_shown"), F.min(exposure_ts).alias("_first_shown")
    )
    first = F.min(F.struct("_converted", "_shown", "_first_shown")).alias("_f")
    out = per_conversion.groupBy(device, placement).agg(first).select(
        device,
        placement,
        F.col("_f._first_shown").alias("first_exposure"),
        F.col("_f._converted").alias("first_conversion"),
        F.col("_f._shown").alias("exposures"),
    )
    return out.withColumn("seconds_to_convert", diff("second", "first_exposure", "first_conversion"))


#: Values of a bucket of the histograms that medians are taken from.
BUCKET = 1024


def grain_medians(counts: DataFrame, keys: Sequence[str], value: str, count: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Exact median per key, from the number of times each value (a whole number) occurs.

    The counts of buckets of values are added up first; the one or two buckets that the
    middle falls into are then searched value by value. So a key with any number of
    values costs a task its buckets, or the values of two of them.
    """
    binned = counts.withColumn("_bucket", F.floor(F.col(value) / bucket))
    by_bucket = binned.groupBy(*keys, "_bucket").agg(F.sum(count).alias("_c"))
    whole, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = by_bucket.withColumns({"_n": F.sum("_c").over(whole), "_before": F.coalesce(F.sum("_c").over(upto), F.lit(0))})
    # the middle, counted from 0: one row twice, or the two rows around it
    middle = placed.withColumns({"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.ceil((F.col("_n") - 1) / 2)})
    holds = lambda at, before, n: (F.col(before) <= F.col(at)) & (F.col(at) < F.col(before) + F.col(n))
    hit = middle.where(holds("_lo", "_before", "_c") | holds("_hi", "_before", "_c")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_before", "_lo", "_hi")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = binned.join(hit, [*same, F.col("_bucket") == F.col("_b")])
    within = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("_first", F.col("_before") + F.coalesce(F.sum(count).over(within), F.lit(0)))
    pick = lambda at: F.max(F.when(holds(at, "_first", count), F.col(value)))
    return inside.groupBy(*keys).agg(((pick("_lo") + pick("_hi")) / 2).alias(name))


def conversion_medians(converted: DataFrame, placement: str = "placement", device: str = "device_id") -> DataFrame:
    """Medians and converters by day and placement, by placement and overall.

    Medians cannot be added up, but the numbers of times that values occur can: these are
    counted once, by day and placement, and summed for the other grains. A null measure
    has no say in its median.
    """
    rows = converted.select(F.to_date("first_exposure").alias("_day"), F.col(placement).alias("_place"), F.col(device).alias("_device"), "exposures", "seconds_to_convert")
    rows = keep(rows)  # read for the counts of values and for those of devices
    grains = F.array(
        F.struct(F.lit("DAY").alias("grain"), F.col("_day").alias("day"), F.col("_place").alias("place")),
        F.struct(F.lit("PLACEMENT").alias("grain"), F.lit(None).cast("date").alias("day"), F.col("_place").alias("place")),
        F.struct(F.lit("TOTAL UNIQUE").alias("grain"), F.lit(None).cast("date").alias("day"), F.lit("ALL").alias("place")),
    )
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value")) for m in ("exposures", "seconds_to_convert")])
    counted = rows.select("_day", "_place", F.explode(measures).alias("_m")).select("_day", "_place", "_m.*").where("value IS NOT NULL")
    counted = counted.groupBy("_day", "_place", "measure", "value").agg(F.count(F.lit(1)).alias("_times"))
    keys = ["grain", "day", "place"]
    summed = counted.withColumn("_g", F.explode(grains)).groupBy(*[F.col(f"_g.{k}").alias(k) for k in keys], "measure", "value").agg(F.sum("_times").alias("_times"))
    medians = grain_medians(summed, [*keys, "measure"], "value", "_times", "median")
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("median")))
    wide = medians.groupBy(*keys).agg(of("exposures").alias("median_exposures"), (of("seconds_to_convert") / 3600).alias("median_hours"))

    # a device counts once in each grain
    devices = rows.groupBy("_day", "_place", "_device").agg(F.lit(1).alias("_one")).withColumn("_g", F.explode(grains))
    devices = devices.groupBy(*[F.col(f"_g.{k}").alias(k) for k in keys]).agg(F.min("_day").alias("first_exposure"), F.countDistinct("_device").alias("conversions"))
    named = wide.select(*[F.col(k).alias(f"_w{k}") for k in keys], "median_exposures", "median_hours")
    out = devices.join(named, [F.col(k).eqNullSafe(F.col(f"_w{k}")) for k in keys], "left").where((F.col("grain") != "TOTAL UNIQUE") | (F.col("conversions") > 0))
    return out.select("grain", "first_exposure", F.col("place").alias("placement"), "median_exposures", "median_hours", "conversions")


def time_to_conversion(
    first_use_touch: DataFrame,
    all_use_touch: DataFrame,
    product: str = "product",
    device: str = "device_id",
    top: int = 15,
) -> DataFrame:
    """Devices and app opens per product and days to convert, with running totals.

    The running totals are over at most ``top + 1`` rows per product.
    """
    bucket = ttc_bucket("days_to_convert", top).alias("bucket")
    users = first_use_touch.groupBy(product, bucket).agg(F.countDistinct(device).alias("users"))
    opens = all_use_touch.groupBy(product, bucket).agg(F.count(device).alias("opens"))
    upto = W.partitionBy(product).orderBy("bucket").rangeBetween(W.unboundedPreceding, 0)
    curve = users.withColumn("cumulative_users", F.sum("users").over(upto)).join(opens, [product, "bucket"])
    return curve.withColumn("cumulative_opens", F.sum("opens").over(upto))


def methodology(app_name: str, country: str, window_days: int, touch: str) -> str:
    """Title printed beside a time-to-conversion table."""
    return f"{app_name.title()} | {country} | Attribution Days: {window_days} | Time to conversion: {touch.title()} touch"
