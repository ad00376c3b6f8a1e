"""What reports read of the fact logs, each log once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import day_end, day_start
from ..functions.predicates import id_in, not_dropped
from ..operators.delivery import CREATIVE_KEYS, split_delivery
from ..operators.rows import keep
from ..operators.usage import app_usage
from ..sources.events import Facts

KINDS = ("impression", "click", "tracker", "segment")


def delivery_logs(
    delivery: DataFrame | Facts, start: datetime, end: datetime, countries: Sequence[str] = (), among: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Impressions, clicks, trackers and pixels of a window, dropped events removed."""
    return split_delivery(Facts.of(delivery).window(start, end, countries, among))


def routed_delivery(
    delivery: DataFrame | Facts,
    mapped: DataFrame,
    segments: Sequence,
    start: datetime,
    end: datetime,
    countries: Sequence[str] = (),
    among: DataFrame | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """One scan for all kinds of events that a report reads: those of mapped creatives
    (``is_mapped``), and the pixels of its segments whether mapped or not.

    The rows are cut to what the report needs and held, so that each kind is read from them.
    """
    seen = Facts.of(delivery).window(start, end, countries, among).where(not_dropped() & F.col("event_type").isin(*KINDS))
    known = mapped.select(*CREATIVE_KEYS).distinct().withColumn("is_mapped", F.lit(True))
    told = seen.join(known, list(CREATIVE_KEYS), "left").withColumn("is_mapped", F.coalesce("is_mapped", F.lit(False)))
    wanted = F.col("is_mapped") | ((F.col("event_type") == "segment") & id_in("segment_id", segments))
    return keep(told.where(wanted).select(*columns, "is_mapped") if columns else told.where(wanted))


def usage_log(
    sessions: DataFrame | Facts,
    profile_map: DataFrame,
    start: datetime,
    end: datetime,
    countries: Sequence[str] = (),
    among: DataFrame | None = None,
    **options,
) -> DataFrame:
    """App usage of the sessions that start in a window; ``options`` are those of app_usage."""
    return app_usage(Facts.of(sessions, "start_ts").window(start, end, countries, among), profile_map, **options)


def older_report_logs(
    delivery: DataFrame | Facts,
    sessions: DataFrame | Facts,
    creative_map: DataFrame,
    profile_map: DataFrame,
    start: date,
    end: date,
    usage_start: date,
    usage_end: date,
    countries: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impressions and clicks of the report's days, and usage of its look-back, all of the
    countries that the creative map has: the logs of the monthly and earlier weekly reports."""
    among = creative_map.where(F.col("country").isNotNull()).select("country")
    logs = delivery_logs(delivery, day_start(start), day_end(end), countries, among)
    usage = usage_log(sessions, profile_map, day_start(usage_start), day_end(usage_end), countries, among, **options)
    return logs["impressions"], logs["clicks"], usage
