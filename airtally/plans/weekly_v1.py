"""Campaign, download and time tables of the earlier weekly report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import date_lit, day
from ..functions.metrics import ratio
from ..functions.predicates import min_duration
from ..operators.asof import SLICE_SECONDS, asof, day_lookup
from ..operators.attribution import daily_usage, distinct_exposure_days, nearest_exposure
from ..operators.delivery import delivery_stats, imps_and_clicks
from ..operators.pixels import exposed_visits_any
from ..operators.rows import keep, semi
from ..operators.usage import installs
from ..sources.events import Facts
from .logs import older_report_logs
from .monthly import CREATIVE, LOG, ON, exposed_first_opens


def _held(impressions: DataFrame, clicks: DataFrame, usage: DataFrame) -> tuple[DataFrame, ...]:
    """The stages both tables read several times, and the union of the two logs."""
    impressions, clicks = (keep(log.select(*LOG)) for log in (impressions, clicks))
    usage = keep(usage.select("country", "device_id", "conversion_ts", "minutes"))
    return impressions, clicks, usage, impressions.unionByName(clicks)


def on_each_day(spans: DataFrame, days: DataFrame, on: Sequence[str], first: str, last: str, name: str) -> DataFrame:
    """A row for each day of a span, from ``first`` to ``last`` (null: no end), between the first and
    the last day of the key in ``days``. A key has at most as many rows as that has days."""
    bounds = days.groupBy(*on).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))  # one row per key
    begin, end = F.greatest(first, "_lo"), F.least(F.coalesce(last, "_hi"), "_hi")
    bounded = spans.join(bounds, list(on)).withColumns({"_begin": begin, "_end": end}).where("_begin <= _end")
    return bounded.withColumn(name, F.explode(F.sequence("_begin", "_end"))).drop("_lo", "_hi", "_begin", "_end")


def opens_by_usage_day(exposures: DataFrame, usage: DataFrame) -> DataFrame:
    """Openers and time per usage day and creative shown earlier or the same day.

    Time is repeated for every exposure day up to the usage day. Each exposure day stands
    for the days until the next one, and meets usage on device and day.
    """
    shown = distinct_exposure_days(exposures, [*ON, "creative_id", "campaign_id"])
    by = W.partitionBy(*ON, "creative_id", "campaign_id").orderBy("expose_date")
    spans = shown.withColumn("_times", F.row_number().over(by)).withColumn("_until", F.date_sub(F.lead("expose_date").over(by), 1))
    days = daily_usage(usage, ON)
    met = on_each_day(spans, days, ON, "expose_date", "_until", "usage_date").join(days, [*ON, "usage_date"])
    return met.groupBy(F.col("usage_date").alias("date"), *CREATIVE).agg(
        F.countDistinct("device_id").alias("openers"), F.sum(F.col("minutes") * F.col("_times")).alias("minutes")
    )


def opens_total(exposures: DataFrame, usage: DataFrame) -> DataFrame:
    """Openers and time per creative: every usage day from the first exposure on, once."""
    firsts = exposures.groupBy(*ON, "creative_id", "campaign_id").agg(F.min(day("event_ts")).alias("expose_date"))
    days = daily_usage(usage, ON)
    found = day_lookup(firsts, days, ON, "expose_date", "usage_date", {"minutes": F.sum("minutes"), "_n": F.sum("sessions")}, 0, None)
    return found.where(F.col("_n") > 0).groupBy(*CREATIVE).agg(F.countDistinct("device_id").alias("openers"), F.sum("minutes").alias("minutes"))


def campaign_table(impressions: DataFrame, clicks: DataFrame, usage: DataFrame, creative_map: DataFrame, since: date | None = None) -> DataFrame:
    """Delivery and exposed use per day and creative. Days without impressions drop out."""
    keys = [*CREATIVE, "date"]
    impressions, clicks, usage, exposures = _held(impressions, clicks, usage)
    credited = usage if since is None else usage.where(day("conversion_ts") >= date_lit(since))
    counted = lambda log, name: delivery_stats(log, name, CREATIVE, count_devices_only=True).withColumnRenamed("date_of_exposure", "date")
    out = (
        counted(impressions, "impressions")
        .join(counted(clicks, "clicks"), keys, "left")
        .join(creative_map, CREATIVE)
        .join(opens_by_usage_day(exposures, credited), keys, "left")
        .join(exposed_first_opens(exposures, usage, None, "open_day", since), keys, "left")
    )
    return out.withColumn("avg_minutes", F.coalesce(ratio("minutes", "openers"), F.lit(0.0)))


def total_table(impressions: DataFrame, clicks: DataFrame, usage: DataFrame, creative_map: DataFrame, start: date, end: date, since: date | None = None) -> DataFrame:
    """The campaign table without days; downloads are those of the country."""
    impressions, clicks, usage, exposures = _held(impressions, clicks, usage)
    credited = usage.where(day("conversion_ts").between(date_lit(start), date_lit(end)))
    if since is not None:
        credited = credited.where(day("conversion_ts") >= date_lit(since))
    counted = lambda log, name: log.groupBy(*CREATIVE).agg(F.count("device_id").alias(name))
    downloads = installs(usage).where(F.col("date").between(date_lit(start), date_lit(end))).groupBy("country").agg(F.sum("installs").alias("downloads"))
    out = (
        counted(impressions, "impressions")
        .join(counted(clicks, "clicks"), CREATIVE, "left")
        .join(creative_map, CREATIVE)
        .join(opens_total(exposures, credited), CREATIVE, "left")
        .join(exposed_first_opens(exposures, usage, None, "total", since), CREATIVE, "left")
        .join(downloads, "country", "left")
    )
    return out.withColumn("hours", F.col("minutes") / 60)


def tables_from_logs(
    delivery: DataFrame | Facts,
    sessions: DataFrame | Facts,
    creative_map: DataFrame,
    profile_map: DataFrame,
    start: date,
    end: date,
    usage_start: date,
    countries: Sequence[str] = (),
    since: date | None = None,
    **usage,
) -> dict[str, DataFrame]:
    """``campaign`` and ``total`` tables from the fact logs, read in the report's days, the
    usage look-back and the mapped countries only. ``usage`` are options of app_usage."""
    logs = older_report_logs(delivery, sessions, creative_map, profile_map, start, end, usage_start, end, countries, **usage)
    return {"campaign": campaign_table(*logs, creative_map, since), "total": total_table(*logs, creative_map, start, end, since)}


def download_table(usage: DataFrame, visits_by_day: DataFrame, start: date, end: date, segments: dict[str, str]) -> DataFrame:
    """Installs per day beside first visits per named segment; days without installs
    drop out."""
    per_day = installs(usage, ("device_id", "country")).groupBy("date").agg(F.sum("installs").alias("downloads"))
    kept = per_day.where(F.col("date").between(date_lit(start), date_lit(end)))
    seen = visits_by_day.groupBy("date").agg(
        *[F.sum(F.when(F.col("segment_id").cast("string") == s, F.col("visits"))).alias(n) for n, s in segments.items()]
    )
    out = kept.join(seen, "date", "left")
    return out.select("date", "downloads", *[F.coalesce(n, F.lit(0)).alias(n) for n in segments])


def time_conversions(
    impressions: DataFrame,
    sessions: DataFrame,
    placements: DataFrame,
    thresholds: dict[str, int],
    start: date,
    end: date,
    first_opened: DataFrame | None = None,
) -> DataFrame:
    """Devices per placement that used the app longer than each threshold on or after
    the day of an exposure.

    That holds when the first exposure day is not later than the last such usage day,
    so one row per device and campaign meets one row per device. ``first_opened``
    restricts the count to devices with a first open in the report.
    """
    shown = impressions.groupBy(*ON, "campaign_id").agg(F.min(day("event_ts")).alias("_shown"))
    if first_opened is not None:
        shown = semi(shown, first_opened, ["device_id"])
    inside = sessions.where(day("start_ts").between(date_lit(start), date_lit(end)))
    last = inside.groupBy(*ON).agg(
        *[F.max(F.when(min_duration("start_ts", "end_ts", s, inclusive=False), day("start_ts"))).alias(f"_last{i}") for i, s in enumerate(thresholds.values())]
    )
    met = shown.join(last, ON).join(placements.select("country", "campaign_id", "placement_name").distinct(), ["country", "campaign_id"])
    labelled = F.explode(F.array(*[F.struct(F.lit(n).alias("threshold"), F.col(f"_last{i}").alias("last")) for i, n in enumerate(thresholds)]))
    rows = met.select("country", "placement_name", "device_id", "_shown", labelled.alias("_t")).where(F.col("_shown") <= F.col("_t.last"))
    return rows.groupBy("country", F.col("_t.threshold").alias("threshold"), "placement_name").agg(F.countDistinct("device_id").alias("conversions"))


def instant_opens(exposures: DataFrame, usage: DataFrame, keys: Sequence[str] = ("creative_name", "placement_name"), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Openers and time per session day and creative, exposures compared by instant.

    A session counts once for each exposure before it. Exposures of earlier days apply
    to the whole day, those of the same day to the sessions after them.
    """
    known = usage.where(F.col("device_id").isNotNull())
    days = known.groupBy("device_id", day("conversion_ts").alias("date")).agg(F.sum("minutes").alias("_day_minutes"))
    shown = exposures.groupBy("device_id", *keys, day("event_ts").alias("_shown_on")).agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy("device_id", *keys).orderBy("_shown_on")
    spans = shown.withColumn("_times", F.sum("_n").over(by)).withColumn("_until", F.lead("_shown_on").over(by))
    later = spans.withColumn("_next_day", F.date_add("_shown_on", 1))
    carried = on_each_day(later, days, ["device_id"], "_next_day", "_until", "date").join(days, ["device_id", "date"])
    carried = carried.select("device_id", *keys, "date", (F.col("_day_minutes") * F.col("_times")).alias("minutes"))
    same_day = asof(
        exposures.select("device_id", *keys, "event_ts", day("event_ts").alias("date")),
        known.select("device_id", "conversion_ts", "minutes", day("conversion_ts").alias("date")),
        ["device_id", "date"], "event_ts", "conversion_ts", sums={"_later": F.col("minutes")}, direction="forward", slice_seconds=slice_seconds,
    ).select("device_id", *keys, "date", F.col("_later").alias("minutes"))
    return carried.unionByName(same_day).groupBy("date", *keys).agg(F.countDistinct("device_id").alias("openers"), F.sum("minutes").alias("minutes"))


def nearest_first_opens(exposures: DataFrame, first_opens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Devices by open day and the creative shown nearest before their first open."""
    best = nearest_exposure(exposures, first_opens, carry=keys)
    return best.groupBy(day("first_ts").alias("date"), *keys).agg(F.countDistinct("device_id").alias("exposed_first_opens"))


def instant_campaign_table(
    impressions: DataFrame,
    clicks: DataFrame,
    usage: DataFrame,
    first_opens: DataFrame,
    visits: DataFrame,
    segments: dict[str, str],
) -> DataFrame:
    """The campaign table with exposures and conversions compared by instant.

    Conversions are counted per day and (creative, placement) name; ``segments`` names a
    pair of columns, all and first visits, for each pixel segment.
    """
    names = ["creative_name", "placement_name"]
    columns = ["device_id", "event_ts", "creative_id", "campaign_id", *names]
    impressions, clicks = (keep(log.select(*columns)) for log in (impressions, clicks))
    exposures = impressions.unionByName(clicks)

    def by_segment(first_only: bool, prefix: str) -> DataFrame:
        seen = exposed_visits_any(exposures, visits, names, first_only=first_only)
        segment = F.col("segment_id").cast("string")
        return seen.groupBy("date", *names).agg(*[F.sum(F.when(segment == s, F.col("visitors"))).alias(f"{prefix}{n}") for n, s in segments.items()])

    out = imps_and_clicks(impressions, clicks, ["creative_id", "campaign_id", *names])
    parts = (
        instant_opens(exposures, usage, names),
        nearest_first_opens(exposures, first_opens, names),
        by_segment(False, ""),
        by_segment(True, "first_"),
    )
    for part in parts:
        out = out.join(part, ["date", *names], "left")
    counted = ["openers", "exposed_first_opens", *segments, *[f"first_{n}" for n in segments]]
    average = F.coalesce(ratio("minutes", "openers"), F.lit(0.0))
    return out.withColumn("avg_minutes", average).withColumns({c: F.coalesce(c, F.lit(0)) for c in counted}).drop("minutes")


def downloads_and_exposures(exposures: DataFrame, first_opens: DataFrame, keys: Sequence[str] = ("creative_name", "placement_name")) -> DataFrame:
    """Diagnostic: first opens per day and creative beside the exposures of that day
    that belong to devices which opened later."""
    opens = nearest_first_opens(exposures, first_opens, keys).withColumnRenamed("exposed_first_opens", "downloads")
    openers = first_opens.groupBy("device_id").agg(F.max("first_ts").alias("_opened"))
    led = exposures.join(openers, "device_id").where(F.col("event_ts") <= F.col("_opened"))
    imps = led.groupBy(day("event_ts").alias("date"), *keys).agg(F.countDistinct("device_id", "event_ts").alias("imps"))
    return opens.join(imps, ["date", *keys], "left").withColumn("imps", F.coalesce("imps", F.lit(0)))
