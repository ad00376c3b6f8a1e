"""Whole reports: fixtures, identities between reports, and the registered SQL."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from airtally.config import ReportConfig
from airtally.operators.curves import methodology
from airtally.plans import mapping as mp
from airtally.plans import validation, weekly
from check import TABLES, compare

from .conftest import rows, ts
from .test_operators import DELIVERY, SESSIONS, event

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


@pytest.mark.parametrize(
    "name",
    ["last_touch_attribution", "first_touch_attribution", "any_touch_opens", "time_credit_once", "exposures_to_convert", "weekly_report",
     "lift_overall", "creative_map_refresh", "only_genre_audience", "department_hours", "chunked_export", "csv_round_trip"],
)
def test_registered_sql(spark, db, name):
    ok, text = compare(spark, db, name, SMALL)
    assert ok, text


def test_contract_is_complete(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_credit_never_exceeds_raw_time(spark):
    got = contract.queries()["reconcile"](spark, SMALL)
    assert got.count() > 0 and got.where("difference < 0 or credited_sessions > sessions").count() == 0
    assert got.where("credited_sessions = sessions and difference <> 0").count() == 0


def test_quadrants_add_up(spark):
    q = contract.queries()["quadrants"](spark, SMALL).first()
    parts = [q.exposed_converted, q.exposed_unconverted, q.unexposed_converted, q.unexposed_unconverted]
    assert sum(parts) == q.universe == contract.queries()["universe"](spark, SMALL).where("device_id is not null").count()


def lines(spark, *specs):
    made = [
        (mapping_country, 1, 1, 1, line, name, av, kind, 2.0, ts(start), ts(end))
        for mapping_country, line, name, av, kind, start, end in specs
    ]
    df = spark.createDataFrame(
        made,
        "mapping_country string, campaign_id int, flight_id int, creative_id int, line_item_id int, line_item_name string, is_added_value int, "
        "rate_type string, rate double, line_item_start_ts timestamp_ntz, line_item_end_ts timestamp_ntz",
    )
    text = {c: F.lit(f"{c}, x") for c in ("advertiser_name", "insertion_order_name", "campaign_name", "flight_name", "creative_name")}
    dates = {c: F.lit(date(2024, 1, 1)) for c in ("campaign_start_date", "campaign_end_date", "flight_start_date", "flight_end_date")}
    return df.withColumns({**text, **dates, "advertiser_id": F.lit(1), "product_name": F.lit("p"), "booked_budget": F.lit(70.0), "placement_impressions_booked": F.lit(5)})


@pytest.fixture(scope="module")
def weekly_inputs(spark):
    log = spark.createDataFrame(
        [event(1, "2024-01-08 10:00:00"), event(1, "2024-01-08 11:00:00"), event(2, "2024-01-09 10:00:00"), event(1, "2024-01-08 12:00:00", "click"),
         event(1, "2024-01-10 12:00:00", "click"), event(1, "2024-01-08 10:00:05", "tracker", tracker="complete"),
         event(3, "2024-01-08 10:00:00", creative=99), event(1, "2024-01-08 13:00:00", "segment", segment="5"), event(1, "2024-01-09 13:00:00", "segment", segment="6")],
        DELIVERY,
    )
    sessions = spark.createDataFrame(
        [(1, 7, "US", ts("2024-01-08 12:00:00"), ts("2024-01-08 12:30:00")), (1, 7, "US", ts("2024-01-09 12:00:00"), ts("2024-01-09 12:10:00")),
         (2, 7, "US", ts("2023-06-01 12:00:00"), ts("2023-06-01 12:10:00")), (2, 7, "US", ts("2024-01-09 12:00:00"), ts("2024-01-09 12:20:00"))],
        SESSIONS,
    )
    profiles = spark.createDataFrame([(1, 1), (2, 2)], "profile_id int, device_id int")
    return log, sessions, profiles


CFG = ReportConfig(as_of=date(2024, 1, 16), start=date(2024, 1, 8), end=date(2024, 1, 14), signup_segment="5", homepage_segment="6")


def test_weekly_report_row(spark, weekly_inputs):
    log, sessions, profiles = weekly_inputs
    mapping = lines(spark, ("US", 100, "Line, a", 0, "CPM", "2024-01-01 00:00:00", "2024-02-01 00:00:00"))
    got = {r.date_of_exposure: r for r in weekly.weekly_report(log, sessions, mapping, profiles, CFG).collect()}
    assert set(got) == {date(2024, 1, 8), date(2024, 1, 9)}
    first, second = got[date(2024, 1, 8)], got[date(2024, 1, 9)]
    assert (first.impressions_delivered, first.clicks, first.reach, first.frequency, first.ctr) == (2, 1, 1, 2.0, 0.5)
    assert first.budget_delivered == 0.004 and first.line_item_name == "Line a" and first.is_fully_attributed == "Yes" and second.is_fully_attributed == "No"
    # both sessions of device 1 go to its last impression; only the first use counts as an install
    assert (first.total_exposed_app_opens, first.total_exposed_app_openers, first.first_time_exposed_app_opens, first.average_exposed_time_spent_minutes) == (2, 1, 1, 20.0)
    # device 2 used the app last year: an open, not an install
    assert (second.total_exposed_app_opens, second.first_time_exposed_app_opens, second.installs) == (1, None, None)
    assert (first.installs, first.video_completions, first.video_start) == (1, 1, 0)
    assert (first.total_signup_page_visit, first.total_exposed_signup_page_visits, first.total_first_time_exposed_signup_page_visits) == (1, 1, 1)
    # the household's later visit is credited to device 2's impression of the same household
    assert (second.total_homepage_page_visits, second.total_exposed_homepage_page_visits, second.total_exposed_signup_page_visits) == (1, 1, 0)


def test_weekly_report_lines(spark, weekly_inputs):
    log, sessions, profiles = weekly_inputs
    mapping = lines(
        spark,
        ("US", 100, "a", 0, "Flat Rate", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
        ("US", 200, "b make good", 0, "CPM", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
        ("US", 300, "ended", 0, "CPM", "2023-01-01 00:00:00", "2024-01-07 23:59:59"),
        ("FR", 400, "abroad", 0, "CPM", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
    )
    plain = weekly.weekly_report(log, sessions, mapping, profiles, CFG)
    assert rows(plain.where("date_of_exposure = '2024-01-08'"), "line_item_id", "impressions_delivered", "budget_delivered") == [(100, 2, 70.0), (200, 2, 0.0)]
    fanned = weekly.weekly_report(log, sessions, mapping, profiles, ReportConfig(**{**CFG.__dict__, "line_fanout": True}))
    assert rows(fanned.where("date_of_exposure = '2024-01-08'"), "line_item_id", "impressions_delivered") == [(100, 4), (200, 4)]
    abroad = weekly.weekly_report(log, sessions, mapping, profiles, ReportConfig(**{**CFG.__dict__, "countries": (" fr ",)}))
    assert abroad.count() == 0
    assert weekly.weekly_report(log, sessions, mapping.limit(0), profiles, CFG).count() == 0


def test_stale_mapping(spark):
    mapping = spark.createDataFrame([(ts("2024-01-01 10:00:00"),), (ts("2023-12-01 10:00:00"),)], "last_update_ts timestamp_ntz")
    assert mp.assert_fresh(mapping, date(2024, 1, 7)) is mapping
    with pytest.raises(mp.StaleMapping):
        mp.assert_fresh(mapping, date(2024, 1, 8))


def test_refresh_window():
    assert [str(x) for x in mp.refresh_window(date(2024, 5, 20))] == ["2024-02-20 00:00:00", "2024-05-19 23:59:59"]


def test_tolerance_and_title(spark):
    ours = spark.createDataFrame([(1, 682), (2, 50)], "k int, n int")
    theirs = spark.createDataFrame([(1, 692), (2, 100)], "k int, n int")
    assert rows(validation.compare_totals(ours, theirs, ["k"], "n"), "k", "within") == [(1, True), (2, False)]
    assert methodology("stream", "US", 30, "first") == "Stream | US | Attribution Days: 30 | Time to conversion: First touch"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def gathered(plan: str) -> list[str]:
    """What goes to a single task, other than the one row per partition of Spark's own
    runtime join filter (a partial aggregate without keys)."""
    lines = plan.split("\n")
    below = [after for line, after in zip(lines, lines[1:]) if "Exchange SinglePartition" in line]
    return [x for x in below if "Aggregate(keys=[], functions=[partial_bloom_filter_agg" not in x]


def test_plans(spark):
    """No pair joins, pushed filters, pruned columns, one row per key before the shuffle."""
    run = contract.queries()
    for name in ("last_touch_attribution", "first_touch_attribution", "any_touch_opens", "time_credit_once", "exposures_to_convert", "exposed_visits", "avg_time_per_user", "instant_opens"):
        plan = plan_of(run[name](spark, SMALL))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
        assert not gathered(plan), name
    plan = plan_of(run["last_touch_attribution"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(ts), EqualTo(event_type,purchase), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "WindowGroupLimit" in plan_of(run["latest_per_key"](spark, SMALL))
