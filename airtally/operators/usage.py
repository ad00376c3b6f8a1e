"""App usage, first use, active users."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_ts, date_lit, day, diff
from ..functions.predicates import min_duration
from .attribution import first_use
from .rows import attach_device, semi


def app_usage(
    sessions: DataFrame,
    profile_map: DataFrame | None = None,
    apps: DataFrame | None = None,
    window: tuple[datetime, datetime] | None = None,
    countries: Sequence[str] = (),
    min_seconds: int = 60,
    inclusive: bool = True,
    dedupe: bool = False,
    unit: str = "minute",
    name: str = "minutes",
) -> DataFrame:
    """Sessions of an app that last long enough, per profile, device and start.

    ``conversion_ts`` is the session start. ``dedupe`` drops repeated log rows first,
    otherwise their time adds up. Profiles without a device keep a null ``device_id``.
    """
    df = sessions
    if window:
        df = df.where(between_ts("start_ts", *window))
    if countries:
        df = df.where(F.col("country").isin(*countries))
    df = df.where(min_duration("start_ts", "end_ts", min_seconds, inclusive))
    if apps is not None:
        df = semi(df, apps, ["app_id"])
    if dedupe:
        df = df.select("profile_id", "country", "start_ts", "end_ts").distinct()
    # sessions shrink to one row per profile and start before they meet the map
    totals = df.groupBy("profile_id", "country", F.col("start_ts").alias("conversion_ts")).agg(
        F.sum(diff(unit, "start_ts", "end_ts")).alias(name), F.max("end_ts").alias("end_ts")
    )
    if profile_map is None:
        return totals
    return attach_device(totals, profile_map)


def app_opens(opened: DataFrame, profile_map: DataFrame) -> DataFrame:
    """Instant app-opened events in the shape of usage; their time is unknown (null)."""
    events = opened.select(
        "profile_id", "country", F.col("event_ts").alias("conversion_ts"), F.lit(None).cast("bigint").alias("minutes")
    ).distinct()
    return attach_device(events, profile_map)


def usage_in(usage: DataFrame, start: datetime, end: datetime, ts: str = "conversion_ts") -> DataFrame:
    return usage.where(between_ts(ts, start, end))


def first_use_in(usage: DataFrame, keys: Sequence[str], start: datetime, end: datetime) -> DataFrame:
    """First use over the whole look-back, kept when it falls inside the window."""
    return first_use(usage, keys).where(between_ts("first_ts", start, end))


def installs(usage: DataFrame, keys: Sequence[str] = ("device_id", "country")) -> DataFrame:
    """Devices by country and day of first use ("downloads")."""
    firsts = usage.groupBy(*keys).agg(F.min(day("conversion_ts")).alias("date"))
    return firsts.groupBy("country", "date").agg(F.count("device_id").alias("installs"))


def active_users(usage: DataFrame, start: date, end: date, daily: bool = False) -> DataFrame:
    """Active, new and returning devices per country, for the period or per day.

    New devices are those whose first use falls in the same period, so they are counted
    from one aggregate per device instead of a second join. Without any new device the
    counts of new and returning devices are null.
    """
    per_device = usage.groupBy("country", "device_id", day("conversion_ts").alias("date")).agg(F.lit(1).alias("_x"))
    firsts = usage.groupBy("country", "device_id").agg(F.min(day("conversion_ts")).alias("first_date"))
    grain = ["country", "date"] if daily else ["country"]
    inside = F.col("date").between(date_lit(start), date_lit(end))
    active = per_device.where(inside).groupBy(*grain).agg(
        F.countDistinct("device_id").alias("active_users")
    )
    fresh = firsts.withColumnRenamed("first_date", "date").where(inside).groupBy(*grain).agg(
        F.count("device_id").alias("new_users")
    )
    out = active.join(fresh, grain, "left")
    return out.withColumn("returning_users", F.col("active_users") - F.col("new_users"))
