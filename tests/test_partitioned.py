"""Reports on partitioned logs read the folders of their windows and countries only."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from airtally.plans import monthly, weekly, weekly_v1
from airtally.sources.events import Facts, read_events, scan_window, write_events

from .conftest import rows, ts
from .test_reports import CFG, lines, plan_of, weekly_inputs  # noqa: F401  (a fixture)


@pytest.fixture(scope="module", autouse=True)
def whole_filters_in_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def facts(spark, weekly_inputs, tmp_path_factory):  # noqa: F811
    log, sessions, profiles = weekly_inputs
    old = log.withColumn("event_ts", F.expr("event_ts - interval 400 days"))
    abroad = log.withColumn("country", F.lit("FR"))
    out = []
    for label, frame, column in (("delivery", log.union(old).union(abroad), "event_ts"), ("sessions", sessions, "start_ts")):
        path = str(tmp_path_factory.mktemp(label))
        write_events(frame, path, column)
        out.append(read_events(spark, path, ", ".join(f"{n} {k}" for n, k in frame.dtypes if n != "country"), column))
    return *out, profiles


def scans(df) -> list[str]:
    """Partition filters of every scan of a fact log."""
    plan = plan_of(df)
    logs = [x for x in re.findall(r"FileScan parquet ([^\n]*)", plan) if re.search(r"Location: [^\]]*/(delivery|sessions|hourly)", x)]
    return [re.search(r"PartitionFilters: (\[.*?\]), PushedFilters", x).group(1) for x in logs]


def check_pruned(df, least: int):
    found = scans(df)
    assert len(found) >= least
    for filters in found:
        assert "event_date" in filters and "dynamicpruning" in filters and "country" in filters, filters


def in_files(df, path):
    """A frame that Spark reads; of values that the driver holds, it would work out the countries at once."""
    df.write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def test_weekly_report(spark, facts, weekly_inputs, tmp_path):  # noqa: F811
    delivery, sessions, profiles = facts
    mapping = in_files(lines(spark, ("US", 100, "Line, a", 0, "CPM", "2024-01-01 00:00:00", "2024-02-01 00:00:00")), tmp_path / "m")
    got = weekly.weekly_report(delivery, sessions, mapping, profiles, CFG)
    log, plain_sessions, _ = weekly_inputs
    wanted = weekly.weekly_report(log, plain_sessions, mapping, profiles, CFG)
    assert rows(got) == rows(wanted) and got.count() == 2
    check_pruned(got, 1)


def creative_map(spark, path):
    df = spark.createDataFrame([("US", 1, 1, "c", "p"), ("FR", 9, 9, "d", "q")], "country string, campaign_id int, creative_id int, creative_name string, placement_name string")
    return in_files(df, path).where("campaign_id = 1")


def test_older_reports(spark, facts, tmp_path):
    delivery, sessions, profiles = facts
    mapped = creative_map(spark, tmp_path / "m")
    period = date(2024, 1, 8), date(2024, 1, 14)
    tables = monthly.monthly_from_logs(delivery, sessions, mapped, profiles, *period, date(2023, 1, 1), period[1])
    days = {r.date: r for r in tables["day"].collect()}
    assert days[date(2024, 1, 8)].impressions == 2 and days[date(2024, 1, 9)].impressions == 1
    for name in ("day", "month"):
        check_pruned(tables[name], 3)
    older = weekly_v1.tables_from_logs(delivery, sessions, mapped, profiles, *period, date(2023, 1, 1))
    assert rows(older["campaign"], "date", "impressions") == [(date(2024, 1, 8), 2), (date(2024, 1, 9), 1)]
    assert rows(older["total"], "impressions", "clicks") == [(3, 2)]
    for table in older.values():
        check_pruned(table, 3)


def test_named_countries_and_hours(spark, weekly_inputs, tmp_path):  # noqa: F811
    log, _, _ = weekly_inputs
    path = str(tmp_path / "hourly")
    write_events(log.union(log.withColumn("country", F.lit("FR"))), path, hourly=True, files_per_day=3)
    facts = read_events(spark, path, ", ".join(f"{n} {k}" for n, k in log.dtypes if n != "country"), hourly=True)
    seen = facts.window(ts("2024-01-08 10:00:00"), ts("2024-01-08 11:00:00"), countries=(" us",))
    wanted = scan_window(log, "event_ts", ts("2024-01-08 10:00:00"), ts("2024-01-08 11:00:00"))
    assert seen.count() == wanted.count() > 0
    (filters,) = scans(seen)
    assert "event_hour" in filters and "lower(country" in filters
    assert len(seen.inputFiles()) and {f.split("event_hour=")[1][:10] for f in seen.inputFiles()} >= {"2024010810"}


def test_a_plain_frame_is_facts_without_folders(weekly_inputs):  # noqa: F811
    log, _, _ = weekly_inputs
    assert Facts.of(log).rows is log and Facts.of(Facts.of(log)).date_partition is None
    assert Facts.of(log).where("event_type = 'click'").rows.count() == 2
