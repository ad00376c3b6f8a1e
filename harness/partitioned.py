"""Reports that read partitioned fact logs: the same tables, written to folders by country and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.plans import mapping as mp
from airtally.plans import monthly, weekly, weekly_v1
from airtally.plans.logs import delivery_logs
from airtally.sources.events import Facts, read_events, write_events
from airtally.storage import new_folder

from .registry import also, query
from .reports import round_weekly
from .tables import CONFIG, END, START, WINDOWS, once_for

USAGE_START = WINDOWS.lookback_start.date()


def on_disk(t, log, ts: str, label: str, hourly: bool = False) -> Facts:
    path = new_folder(t.spark, label)
    write_events(log, path, ts, hourly=hourly)
    held = ", ".join(f"{name} {kind}" for name, kind in log.dtypes if name != "country")
    return read_events(t.spark, path, held, ts, hourly)


@once_for
def delivery_facts(t) -> Facts:
    return on_disk(t, t.delivery(), "event_ts", "delivery")


@once_for
def session_facts(t) -> Facts:
    return on_disk(t, t.sessions(), "start_ts", "sessions")


@also("weekly_from_facts", "weekly_report")
def weekly_from_facts(t):
    mapping = mp.enrich_mapping(t.mapping(), t.order_meta())
    return round_weekly(weekly.weekly_report(delivery_facts(t), session_facts(t), mapping, t.profile_map(), CONFIG))


@also("monthly_from_facts", "monthly_report")
def monthly_from_facts(t):
    tables = monthly.monthly_from_logs(delivery_facts(t), session_facts(t), t.creative_map(), t.profile_map(), START, END, USAGE_START, END, min_seconds=3600)
    return tables["day"]


@also("weekly_v1_from_facts", "weekly_v1_campaign")
def v1_campaign_from_facts(t):
    tables = weekly_v1.tables_from_logs(delivery_facts(t), session_facts(t), t.creative_map(), t.profile_map(), START, END, USAGE_START, min_seconds=3600)
    return tables["campaign"].withColumn("avg_minutes", F.round("avg_minutes", 6))


@query(
    "countries_window",
    "impressions",
    """SELECT country, CAST(event_ts AS DATE) AS date, count(*) AS impressions FROM impressions
WHERE country IN ('NATION_3', 'NATION_7') AND event_ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 11:59:59' GROUP BY ALL""",
)
def countries_window(t):
    """A country list in another spelling and a window that ends at noon, from hourly folders."""
    facts = on_disk(t, t.impressions(), "event_ts", "hourly", hourly=True)
    start, end = WINDOWS.report_start.replace(day=10), WINDOWS.report_start.replace(day=12, hour=11, minute=59, second=59)
    seen = delivery_logs(facts, start, end, (" nation_3", "Nation_7"))["impressions"]
    return seen.groupBy("country", F.to_date("event_ts").alias("date")).agg(F.count(F.lit(1)).alias("impressions"))
