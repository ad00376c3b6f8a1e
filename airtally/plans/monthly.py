"""Monthly report per country: delivery and exposed use by day and month, active users."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_lit, day, ts_lit
from ..operators.attribution import any_touch, any_touch_by_day, attribute, credit_once
from ..operators.delivery import delivery_stats
from ..operators.rows import keep
from ..operators.usage import active_users, installs
from ..sources.events import Facts
from .logs import older_report_logs

CREATIVE = ["country", "campaign_id", "creative_id"]
ON = ["device_id", "country"]
LOG = ["country", "device_id", "event_ts", "creative_id", "campaign_id"]


def exposed_first_opens(
    exposures: DataFrame,
    usage: DataFrame,
    window_days: int | None = 14,
    grain: str = "exposure_day",
    since: date | None = None,
) -> DataFrame:
    """Devices by the creative last shown on or before the day of their first open.

    ``grain`` dates them by ``exposure_day`` or ``open_day``, or not at all (``total``).
    """
    firsts = usage.groupBy("country", "device_id").agg(F.min(day("conversion_ts")).alias("first_open"))
    if since is not None:
        firsts = firsts.where(F.col("first_open") >= date_lit(since))
    found = attribute(
        exposures, firsts, ON, "last", window_days, conversion_ts="first_open",
        carry=("creative_id", "campaign_id"), tiebreak=("creative_id", "campaign_id"), grain="day",
    )
    dates = {"exposure_day": [F.col("hit.ts").alias("date")], "open_day": [F.col("first_open").alias("date")], "total": []}[grain]
    return found.groupBy("country", *dates, F.col("hit.creative_id").alias("creative_id"), F.col("hit.campaign_id").alias("campaign_id")).agg(
        F.countDistinct("device_id").alias("exposed_first_opens")
    )


def monthly_parts(impressions: DataFrame, clicks: DataFrame, usage: DataFrame, window_days: int, since: date | None = None) -> dict[str, DataFrame]:
    """The aggregates both monthly tables are assembled from."""
    exposures = impressions.select(*LOG).unionByName(clicks.select(*LOG))
    credited = usage if since is None else usage.where(F.col("conversion_ts") >= ts_lit(since))
    counted = lambda log, name: delivery_stats(log, name, CREATIVE, count_devices_only=True).withColumnRenamed("date_of_exposure", "date")
    return {
        "impressions": counted(impressions, "impressions"),
        "clicks": counted(clicks, "clicks"),
        "opens": any_touch_by_day(any_touch(exposures, credited, ON, window_days)).withColumnRenamed("expose_date", "date"),
        "opens_once": credit_once(exposures, credited, ON, window_days)
        .groupBy(*CREATIVE)
        .agg(F.count("device_id").alias("openers"), F.sum("minutes").alias("minutes")),
        "first_opens": exposed_first_opens(exposures, usage, window_days, since=since),
    }


def monthly_report(
    impressions: DataFrame,
    clicks: DataFrame,
    usage: DataFrame,
    creative_map: DataFrame,
    start: date,
    end: date,
    usage_end: date,
    window_days: int = 14,
    countries: Sequence[str] = (),
    since: date | None = None,
) -> dict[str, DataFrame]:
    """``day``, ``month`` and ``active_days`` tables for all countries at once.

    ``creative_map`` holds country, campaign_id, creative_id, creative_name,
    placement_name. The day table has a row per creative and day with active users.
    """
    if countries:
        wanted = F.col("country").isin(*countries)
        impressions, clicks, usage, creative_map = (df.where(wanted) for df in (impressions, clicks, usage, creative_map))
    impressions, clicks = (keep(log.select(*LOG)) for log in (impressions, clicks))
    usage = keep(usage.select("country", "device_id", "conversion_ts", "minutes"))
    parts = monthly_parts(impressions, clicks, usage, window_days, since)
    daily_users = active_users(usage, start, usage_end, daily=True)
    keys = [*CREATIVE, "date"]
    in_month = F.col("date").between(date_lit(start), date_lit(end))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)

    skeleton = creative_map.join(daily_users.select("country", "date").where(in_month), "country")
    by_day = skeleton
    for name in ("impressions", "clicks", "opens", "first_opens"):
        by_day = by_day.join(parts[name], keys, "left")
    by_day = by_day.select(
        *creative_map.columns, "date", zero("impressions"), zero("clicks"), "openers", "exposed_first_opens", "minutes",
        F.round(F.col("minutes") / 60, 2).alias("hours"),
    )

    # clicks and first opens count on days with impressions of the creative only
    delivered = parts["impressions"].join(parts["clicks"], keys, "left").join(parts["first_opens"], keys, "left")
    totals = delivered.groupBy(*CREATIVE).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("exposed_first_opens").alias("exposed_first_opens"))
    by_month = (
        creative_map.join(active_users(usage, start, usage_end), "country")
        .join(totals, CREATIVE, "left")
        .join(parts["opens_once"], CREATIVE, "left")
        .select(
            *creative_map.columns, zero("impressions"), zero("clicks"), "openers", "exposed_first_opens", "minutes",
            F.round(F.col("minutes") / 60, 2).alias("hours"), "active_users", "new_users", "returning_users",
        )
    )
    active_days = daily_users.join(installs(usage), ["country", "date"]).select("country", "date", "installs", "active_users", "new_users", "returning_users")
    return {"day": by_day, "month": by_month, "active_days": active_days}


def monthly_from_logs(
    delivery: DataFrame | Facts,
    sessions: DataFrame | Facts,
    creative_map: DataFrame,
    profile_map: DataFrame,
    start: date,
    end: date,
    usage_start: date,
    usage_end: date,
    window_days: int = 14,
    countries: Sequence[str] = (),
    since: date | None = None,
    **usage,
) -> dict[str, DataFrame]:
    """The monthly report from the fact logs, read in its days and countries only.
    ``usage`` are options of app_usage."""
    logs = older_report_logs(delivery, sessions, creative_map, profile_map, start, end, usage_start, usage_end, countries, **usage)
    return monthly_report(*logs, creative_map, start, end, usage_end, window_days, countries, since)
