"""A scheduled report from its arguments to the delivered files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..sinks.commits import Manifest
from ..sinks.reports import Destinations, Report, commit_reports, report_name
from ..sources.events import Facts
from ..sources.files import app_ids
from .mapping import assert_fresh, enrich_mapping
from .monthly import monthly_from_logs
from .weekly import REPORT_COLUMNS, REPORT_ORDER, weekly_report


class UnknownApp(ValueError):
    """No app has the report's app name."""


@dataclass(frozen=True)
class Inputs:
    """The tables a report run reads."""

    delivery: DataFrame | Facts
    sessions: DataFrame | Facts
    mapping: DataFrame
    orders: DataFrame
    profile_map: DataFrame
    app_meta: DataFrame | None = None


def wanted_apps(inputs: Inputs, cfg: ReportConfig) -> DataFrame | None:
    """Ids of the apps with the report's app name; without a name usage of all apps counts. A name that
    no app has is an error, or the report would be without usage."""
    if not cfg.app_name:
        return None
    if inputs.app_meta is None:
        raise UnknownApp(f"no apps are given to look {cfg.app_name} up in")
    apps = app_ids(inputs.app_meta, name=cfg.app_name)
    if apps.isEmpty():
        raise UnknownApp(cfg.app_name)
    return apps


def report_tables(inputs: Inputs, cfg: ReportConfig) -> list[Report]:
    """The tables of the report's interval, from a mapping that is fresh and has its order flags."""
    mapping = enrich_mapping(assert_fresh(inputs.mapping, cfg.as_of), inputs.orders)
    apps = wanted_apps(inputs, cfg)
    if cfg.interval == "weekly":
        rows = weekly_report(inputs.delivery, inputs.sessions, mapping, inputs.profile_map, cfg, apps)
        return [Report("campaign", rows, REPORT_ORDER, REPORT_COLUMNS)]
    if cfg.interval != "monthly":
        raise ValueError(f"no report is run {cfg.interval}")
    w = cfg.windows()
    creatives = mapping.select(
        F.col("mapping_country").alias("country"), "campaign_id", "creative_id", "creative_name", F.col("line_item_name").alias("placement_name")
    ).distinct()
    tables = monthly_from_logs(
        inputs.delivery, inputs.sessions, creatives, inputs.profile_map, w.report_start.date(), w.report_end.date(), w.lookback_start.date(), w.report_end.date(),
        cfg.attribution_days, cfg.countries, apps=apps, min_seconds=cfg.min_session_seconds, inclusive=cfg.session_inclusive,
    )
    dated = F.lit(cfg.as_of).alias("report_execution_date")
    out = []
    for table, rows in tables.items():
        keys = [c for c in ("country", "date", "campaign_id", "creative_id", "creative_name", "placement_name") if c in rows.columns]
        out.append(Report(table, rows.select(dated, *rows.columns), keys, ["report_execution_date", *rows.columns]))
    return out


def arguments(cfg: ReportConfig, region: str, more: Mapping | None = None) -> dict:
    """What a run's manifest says of its arguments."""
    said = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in asdict(cfg).items()}
    return {**said, "region": region, **(more or {})}


def run_report(inputs: Inputs, cfg: ReportConfig, destinations: Destinations, region: str) -> list[Manifest]:
    """Run a report and deliver it: freshness guard, enrichment, the app's usage, the report's tables,
    files of at most ``cfg.max_rows`` rows, and a manifest in every folder that the region and
    ``cfg.receipts`` ask for. Readers see the run before until the manifest is there."""
    w = cfg.windows()
    routed = Destinations(**{**asdict(destinations), "receipts": cfg.receipts})

    def name(table: str, sequence: int) -> str:
        return report_name(cfg.partner, region, cfg.interval, table, w.report_start.date(), w.report_end.date(), sequence)

    return commit_reports(report_tables(inputs, cfg), routed.folders(region), name, arguments(cfg, region), cfg.as_of, cfg.max_rows)
