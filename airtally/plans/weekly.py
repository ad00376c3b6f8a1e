"""The weekly delivery report: delivery, cost, video, and credited conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..functions import metrics as m
from ..functions.dates import between_ts, date_lit, day, ts_lit
from ..functions.predicates import active_in
from ..operators import delivery as d
from ..operators.attribution import attribute, first_use
from ..operators.pixels import exposed_visits, household_map, pixel_visits, visits_by_day
from ..operators.rows import keep
from ..sources.events import Facts
from .logs import routed_delivery, usage_log

ROW_KEYS = ["date_of_exposure", *d.CREATIVE_KEYS]

# Columns of the delivered file, in order.
REPORT_COLUMNS = (
    "report_execution_date", "date_of_exposure", "is_fully_attributed", "advertiser_id", "advertiser",
    "insertion_order_name", "campaign_id", "campaign_name", "campaign_start_date", "campaign_end_date",
    "flight_id", "flight_name", "flight_start_date", "flight_end_date", "line_item_id", "line_item_name",
    "creative_id", "creative_name", "product_name", "rate_type", "rate", "placement_impressions_booked",
    "booked_budget", "impressions_delivered", "budget_delivered", "clicks", "ctr", "cpc", "reach", "frequency",
    "installs", "average_exposed_time_spent_minutes", "video_start", "video_25", "video_50", "video_75",
    "video_completions", "total_exposed_app_openers", "total_exposed_app_opens", "first_time_exposed_app_opens",
    "total_signup_page_visit", "total_exposed_signup_page_visits", "total_first_time_exposed_signup_page_visits",
    "total_homepage_page_visits", "total_exposed_homepage_page_visits",
    "total_first_time_exposed_homepage_page_visits",
)
# Rows are delivered in this order; it is total over the report's rows.
REPORT_ORDER = (
    "advertiser", "mapping_country", "date_of_exposure", "campaign_id", "flight_id", "line_item_id", "creative_id",
    "impressions_delivered", "line_item_start_ts", "line_item_end_ts", "product_name",
)


def active_lines(mapping: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Mapping rows of lines active in the report window and of the wanted countries."""
    return _active(mapping, cfg).distinct()


def mapped_countries(mapping: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Countries of the active lines. The mapping is cut to three columns first, so that
    the plan is not that of held lines: Spark prunes the folders of other countries only
    where it sees a filter on the mapping."""
    cut = mapping.select("mapping_country", "line_item_start_ts", "line_item_end_ts")
    return _active(cut, cfg).where(F.col("mapping_country").isNotNull()).select(F.col("mapping_country").alias("country"))


def _active(mapping: DataFrame, cfg: ReportConfig) -> DataFrame:
    w = cfg.windows()
    kept = mapping.where(active_in("line_item_start_ts", "line_item_end_ts", ts_lit(w.report_start), ts_lit(w.report_end)))
    if cfg.countries:
        kept = kept.where(F.lower("mapping_country").isin(*[c.strip().lower() for c in cfg.countries]))
    return kept


def exposed_opens(impressions: DataFrame, usage: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Last touch for every session of the report window. ``is_first`` marks the first
    session of the look-back, so that installs share the attribution of their session."""
    w = cfg.windows()
    end = w.attribution_end if cfg.attribution_extends else w.report_end
    keys = ["device_id", "profile_id", "country"]
    known = usage.where(F.col("device_id").isNotNull())
    marked = known.join(first_use(known, keys), keys).withColumn("is_first", F.col("conversion_ts") == F.col("first_ts"))
    inside = keep(marked.where(between_ts("conversion_ts", w.report_start, end)).drop("first_ts"))
    return attribute(
        impressions, inside, ["device_id", "country"], "last", cfg.attribution_days,
        carry=("campaign_id", "flight_id", "creative_id"), tiebreak=("event_id",),
    )


def _credited(found: DataFrame) -> list:
    return [
        F.to_date("hit.ts").alias("date_of_exposure"),
        "country",
        *[F.col(f"hit.{c}").alias(c) for c in ("campaign_id", "flight_id", "creative_id")],
    ]


def open_counts(opens: DataFrame) -> DataFrame:
    """Opens, openers, installs and mean minutes per exposure day and creative."""
    per_device = opens.groupBy(*_credited(opens), "device_id").agg(
        F.count(F.lit(1)).alias("_opens"),
        F.sum("minutes").alias("_min"),
        F.count("minutes").alias("_timed"),
        F.max("is_first").alias("_first"),
    )
    return per_device.groupBy(*ROW_KEYS).agg(
        F.sum("_opens").alias("total_exposed_app_opens"),
        m.ratio(F.sum("_min"), F.sum("_timed")).alias("average_exposed_time_spent_minutes"),
        F.count(F.lit(1)).alias("total_exposed_app_openers"),
        F.nullif(F.count_if("_first"), F.lit(0)).alias("first_time_exposed_app_opens"),
    )


def visit_counts(visits: DataFrame, signup: str, homepage: str) -> DataFrame:
    """Households per exposure day and creative, by segment, all and first visits."""
    segment = F.col("segment_id").cast("string")
    flags = {"signup": segment == signup, "homepage": segment == homepage}
    per_household = visits.groupBy(*_credited(visits), "household_id").agg(
        *[F.max(cond).alias(f"_{n}") for n, cond in flags.items()],
        *[F.max(cond & F.col("is_first")).alias(f"_first_{n}") for n, cond in flags.items()],
        F.max("is_first").alias("_any_first"),
    )
    some_first = F.max("_any_first")
    return per_household.groupBy(*ROW_KEYS).agg(
        *[F.count_if(f"_{n}").alias(f"total_exposed_{n}_page_visits") for n in flags],
        *[F.when(some_first, F.count_if(f"_first_{n}")).alias(f"total_first_time_exposed_{n}_page_visits") for n in flags],
    )


def core_rows(lines: DataFrame, impressions: DataFrame, clicks: DataFrame, any_spelling: bool = False) -> DataFrame:
    """Line x day with impressions, clicks, reach and cost. Days without impressions
    are left out, and so are the clicks of such days."""
    shown = d.impressions_and_reach(impressions)
    clicked = d.delivery_stats(clicks, "clicks")
    stats = shown.join(clicked, ROW_KEYS, "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    stats = stats.withColumnRenamed("country", "mapping_country")
    rows = lines.join(stats, ["mapping_country", "campaign_id", "flight_id", "creative_id"]).withColumnRenamed("impressions", "impressions_delivered")
    return rows.withColumn(
        "budget_delivered",
        m.budget_delivered("line_item_name", "is_added_value", "rate_type", "impressions_delivered", "rate", "booked_budget", any_spelling),
    )


def weekly_report(
    delivery: DataFrame | Facts,
    sessions: DataFrame | Facts,
    mapping: DataFrame,
    profile_map: DataFrame,
    cfg: ReportConfig,
    apps: DataFrame | None = None,
) -> DataFrame:
    """All countries in one plan. ``mapping`` is the enriched creative mapping.

    Each log is read once, in the report's windows and the mapped countries. Every right
    side of the final join chain is aggregated to the row key first. The stages read
    more than once (the routed log, usage, pixels) are cut to their needed columns and held.
    """
    w = cfg.windows()
    conversions_end = w.attribution_end if cfg.attribution_extends else w.report_end
    among = mapped_countries(mapping, cfg)
    lines = keep(active_lines(mapping, cfg))
    mapped = lines.select(F.col("mapping_country").alias("country"), "campaign_id", "flight_id", "creative_id", "line_item_id")

    segments = (cfg.signup_segment, cfg.homepage_segment)
    columns = (*d.CREATIVE_KEYS, "event_type", "event_ts", "event_id", "device_id", "household_id", "segment_id", "tracker", "dropped")
    since, until = min(w.pixel_start, w.report_start), max(w.report_end, conversions_end)
    log = routed_delivery(delivery, mapped, segments, since, until, cfg.countries, among, columns)
    shown = log.where("is_mapped").drop("is_mapped")
    logs = d.split_delivery(shown.where(between_ts("event_ts", w.report_start, w.report_end)))
    if cfg.line_fanout:
        logs = {kind: d.in_creative_map(rows, mapped, True) for kind, rows in logs.items()}
    clicks, tracker = logs["clicks"], logs["tracker"]
    impressions = logs["impressions"].select(*d.CREATIVE_KEYS, "device_id", "household_id", "event_ts", "event_id")

    usage = usage_log(
        sessions, profile_map, w.lookback_start, conversions_end, cfg.countries, among,
        apps=apps, min_seconds=cfg.min_session_seconds, inclusive=cfg.session_inclusive,
    )
    usage = keep(usage.drop("end_ts"))
    opens = open_counts(exposed_opens(impressions, usage, cfg))

    households = household_map(shown.where(between_ts("event_ts", w.pixel_start, w.report_end)), profile_map)
    pixels = pixel_visits(log, households, segments, (w.pixel_start, conversions_end))
    pixels = keep(pixels.drop("device_id"))
    visits = exposed_visits(impressions, pixels, cfg.attribution_days)
    # a first visit counts only when it falls in the report window
    visits = visits.withColumn("is_first", F.col("is_first") & between_ts("conversion_ts", w.report_start, conversions_end))
    visited = visit_counts(visits, cfg.signup_segment, cfg.homepage_segment)
    in_report = F.col("date_of_exposure").between(date_lit(w.report_start.date()), date_lit(w.report_end.date()))
    all_visits = visits_by_day(
        pixels, {"total_signup_page_visit": cfg.signup_segment, "total_homepage_page_visits": cfg.homepage_segment}
    ).where(in_report)
    # several profiles of a device may have their first use on the same day
    installed = (
        usage.groupBy("device_id", "profile_id", "country")
        .agg(F.min("conversion_ts").alias("_first"))
        .where(between_ts("_first", w.report_start, conversions_end))
        .groupBy("country", day("_first").alias("date_of_exposure"))
        .agg(F.countDistinct("device_id").alias("installs"))
    )

    rows = core_rows(lines.drop("budget_delivered"), impressions, clicks).withColumn("country", F.col("mapping_country"))
    for part in (opens, d.video_tiles(tracker), visited):
        rows = rows.join(part, ROW_KEYS, "left")
    for part in (installed, all_visits):
        rows = rows.join(part, ["country", "date_of_exposure"], "left")

    text = ("advertiser_name", "insertion_order_name", "campaign_name", "flight_name", "line_item_name", "creative_name")
    for c in text:
        rows = rows.withColumn(c, m.strip_commas(c))
    tiles = {t: F.coalesce(t, F.lit(0)) for t in m.VIDEO_TILES}
    rows = rows.withColumns(
        {
            **tiles,
            "advertiser": F.col("advertiser_name"),
            "report_execution_date": date_lit(cfg.as_of),
            "is_fully_attributed": m.is_fully_attributed("date_of_exposure", date_lit(cfg.as_of), cfg.attribution_days),
            "ctr": m.ctr("clicks", "impressions_delivered"),
            "cpc": m.cpc("budget_delivered", "clicks"),
            "frequency": m.frequency("impressions_delivered", "reach"),
        }
    )
    extra = [c for c in REPORT_ORDER if c not in REPORT_COLUMNS]
    return rows.select(*REPORT_COLUMNS, *extra).distinct()
