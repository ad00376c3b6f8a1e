"""Operators on small frames with planted edge cases."""

from datetime import date
from itertools import count

import pytest
from pyspark.sql import functions as F

from airtally.config import blackout_window
from airtally.operators import audiences as au
from airtally.operators import delivery as d
from airtally.operators import lift, pixels, rows as rw, universe, usage
from airtally.operators import timesheet as sheet

from .conftest import rows, ts

SESSIONS = "profile_id int, app_id int, country string, start_ts timestamp_ntz, end_ts timestamp_ntz"


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(
        [
            (1, 7, "US", ts("2024-01-05 10:00:59"), ts("2024-01-05 10:01:59")),  # 60 s over one minute boundary
            (1, 7, "US", ts("2024-01-05 10:00:59"), ts("2024-01-05 10:01:59")),  # repeated row
            (2, 7, "US", ts("2024-01-06 10:00:00"), ts("2024-01-06 10:05:00")),  # profile without a device
            (3, 8, "US", ts("2024-01-07 10:00:00"), ts("2024-01-07 11:00:00")),  # another app
            (4, 7, "FR", ts("2024-02-01 00:00:00"), ts("2024-02-01 00:00:59")),  # too short
            (5, 7, "FR", ts("2024-02-02 00:00:00"), ts("2024-02-02 02:00:00")),
        ],
        SESSIONS,
    )


@pytest.fixture(scope="module")
def profile_map(spark):
    return spark.createDataFrame([(1, 10), (3, 30), (4, 40), (5, 10)], "profile_id int, device_id int")


def test_app_usage(spark, sessions, profile_map):
    apps = spark.createDataFrame([(7,), (7,)], "app_id int")
    got = usage.app_usage(sessions, profile_map, apps)
    assert rows(got, "device_id", "profile_id", "minutes") == [(None, 2, 5), (10, 1, 2), (10, 5, 120)]
    once = usage.app_usage(sessions, profile_map, apps, dedupe=True)
    assert rows(once.where("profile_id = 1"), "minutes") == [(1,)]
    over = usage.app_usage(sessions, profile_map, apps, inclusive=False)
    assert rows(over, "profile_id") == [(2,), (5,)]
    assert rows(usage.app_usage(sessions, profile_map, countries=("FR",)), "profile_id") == [(5,)]


def test_installs_and_active_users(sessions, profile_map):
    used = usage.app_usage(sessions, profile_map)
    assert rows(usage.installs(used), "country", F.col("date").cast("string"), "installs") == [
        ("FR", "2024-02-02", 1), ("US", "2024-01-05", 1), ("US", "2024-01-06", 0), ("US", "2024-01-07", 1),
    ]
    month = usage.active_users(used, date(2024, 1, 6), date(2024, 1, 31))
    # the profile without a device is active but cannot be counted
    assert rows(month) == [("US", 1, 1, 0)]
    assert rows(usage.active_users(used, date(2024, 1, 1), date(2024, 1, 31))) == [("US", 2, 2, 0)]


def test_audiences_set_operations(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in v], "device_id int") for v in ([1, 2, 2, None], [2, 3, None], [2, 4]))
    assert rows(rw.audience_or(a, b)) == [(None,), (1,), (2,), (3,)]
    assert rows(rw.audience_and(a, b, c)) == [(2,)]
    # NOT IN drops null rows on the left and ignores nulls on the right
    assert rows(rw.exclude(a, b, "device_id")) == [(1,)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 9), (2, 1, 3)], "k int, version int, id int")
    assert rows(rw.latest_per_key(df, ["k"], ["version", "id"]), "k", "id") == [(1, 2), (2, 3)]
    assert rows(rw.latest_per_key(df, ["k"], ["version", "id"], ascending=True), "k", "id") == [(1, 1), (2, 3)]


def test_contained_in(spark):
    inner = spark.createDataFrame(
        [(1, "a", ts("2024-01-01 10:10:00"), ts("2024-01-01 10:20:00")), (1, "b", ts("2024-01-01 12:59:00"), ts("2024-01-01 13:00:00")),
         (1, "c", ts("2024-01-01 12:59:00"), ts("2024-01-01 13:00:01")), (2, "d", ts("2024-01-01 10:10:00"), ts("2024-01-01 10:20:00"))],
        "p int, name string, i0 timestamp_ntz, i1 timestamp_ntz",
    )
    outer = spark.createDataFrame(
        [(1, "long", ts("2024-01-01 09:00:00"), ts("2024-01-01 13:00:00")), (1, "short", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:30:00"))],
        "p int, session string, o0 timestamp_ntz, o1 timestamp_ntz",
    )
    for seconds in (60, 3600, 86400):
        got = rw.contained_in(inner, outer, ["p"], ("i0", "i1"), ("o0", "o1"), seconds)
        assert rows(got, "name", "session") == [("a", "long"), ("a", "short"), ("b", "long")]


DELIVERY = (
    "device_id int, household_id int, country string, event_ts timestamp_ntz, event_type string, campaign_id int, flight_id int, "
    "creative_id int, segment_id string, tracker string, dropped boolean, exchange_id int, exchange_seller_id string, event_id int"
)


IDS = count(1)


def event(device, at, kind="impression", house=1, creative=1, segment=None, tracker=None, dropped=None, exchange=1, seller="0"):
    return (device, house, "US", ts(at), kind, 1, 1, creative, segment, tracker, dropped, exchange, seller, next(IDS))


def test_split_and_counts(spark):
    log = spark.createDataFrame(
        [event(1, "2024-01-08 01:00:00"), event(1, "2024-01-08 02:00:00"), event(None, "2024-01-08 03:00:00"), event(2, "2024-01-08 04:00:00", dropped=True),
         event(2, "2024-01-09 01:00:00", "click", dropped=True), event(3, "2024-01-08 05:00:00", "tracker", tracker="midpoint")],
        DELIVERY,
    )
    parts = d.split_delivery(log)
    assert parts["impressions"].count() == 3 and parts["clicks"].count() == 0
    assert d.split_delivery(log, drop_clicks_too=False)["clicks"].count() == 1
    assert rows(d.impressions_and_reach(parts["impressions"]), "impressions", "reach") == [(3, 1)]
    assert rows(d.delivery_stats(parts["impressions"], "n", count_devices_only=True), "n") == [(2,)]
    assert rows(d.video_tiles(parts["tracker"]), "video_50", "video_start") == [(1, None)]
    lists = spark.createDataFrame([([],), (["x", "y"],)], "device_ids array<string>")
    assert rows(d.first_device(lists), "device_id") == [(None,), ("x",)]


def test_creative_fan_out(spark):
    log = spark.createDataFrame([event(1, "2024-01-08 01:00:00")], DELIVERY)
    cmap = spark.createDataFrame([("US", 1, 1, 1, 100), ("US", 1, 1, 1, 200)], "country string, campaign_id int, flight_id int, creative_id int, line_item_id int")
    assert d.in_creative_map(log, cmap).count() == 1
    assert d.in_creative_map(log, cmap, line_fanout=True).count() == 2
    assert d.in_creative_map(log, cmap.limit(0)).count() == 0


def test_clicks_without_impressions_drop_out(spark):
    imps = spark.createDataFrame([event(1, "2024-01-08 01:00:00")], DELIVERY)
    clicks = spark.createDataFrame([event(1, "2024-01-08 02:00:00", "click"), event(1, "2024-01-09 02:00:00", "click")], DELIVERY)
    assert rows(d.imps_and_clicks(imps, clicks, ["creative_id"]), "impressions", "clicks") == [(1, 1)]


def test_universe_and_qualifier(spark, profile_map):
    hardware = spark.createDataFrame([(1,), (99,)], "profile_id int")
    opened = spark.createDataFrame([(3,)], "profile_id int")
    log = spark.createDataFrame(
        [event(50, "2024-01-08 01:00:00", exchange=6), event(51, "2024-01-08 01:00:00", seller="86"), event(52, "2024-01-08 01:00:00"),
         event(53, "2024-01-08 01:00:00", exchange=6, dropped=True), event(54, "2024-01-08 01:00:00", "click", exchange=6)],
        DELIVERY,
    )
    assert rows(universe.universe(hardware, log, opened, profile_map)) == [(10,), (30,), (50,), (51,)]
    start = ts("2024-01-08 05:00:00")
    known = universe.qualify_universe_start(log, start).first()
    assert known.qualifier == "Superset" and known.universe_start == start and known.seller_list == '"0","86"'
    other = universe.qualify_universe_start(log.where("exchange_seller_id = '0'"), start).first()
    assert other.qualifier == "Superset +30 days" and str(other.universe_start) == "2023-12-09 00:00:00"
    assert universe.qualify_universe_start(log.limit(0), start).first().qualifier == "Superset +30 days"


def test_blackout_and_quadrants(spark):
    devices = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "device_id int")
    used = spark.createDataFrame([(1, ts("2023-12-31 23:59:59")), (None, ts("2023-12-01 00:00:00")), (2, ts("2024-01-01 00:00:00"))], "device_id int, conversion_ts timestamp_ntz")
    mini = universe.mini_universe(devices, used, blackout_window(date(2024, 1, 1)))
    assert rows(mini) == [(2,), (3,), (4,), (5,)]
    exposed = spark.createDataFrame([(2,), (3,), (None,)], "device_id int")
    q = universe.quadrants(mini, exposed, used).first()
    assert tuple(q) == (1, 1, 0, 2, 4) and sum(q[:4]) == q.universe


def test_households_and_visits(spark, profile_map):
    log = spark.createDataFrame(
        [event(10, "2024-01-08 01:00:00", house=1), event(30, "2024-01-09 01:00:00", house=1), event(77, "2024-01-10 01:00:00", house=1),
         event(10, "2024-01-09 02:00:00", "segment", house=1, segment="5"), event(10, "2024-01-09 03:00:00", "segment", house=1, segment="5"),
         event(10, "2024-01-09 03:00:00", "segment", house=2, segment="5"), event(10, "2024-01-09 03:00:00", "segment", house=1, segment="6")],
        DELIVERY,
    )
    homes = pixels.household_map(log, profile_map)
    # device 77 is unknown to the map, so 30 is the last one seen
    assert rows(homes, "household_id", "device_id", "profile_id") == [(1, 30, 3)]
    window = (ts("2024-01-08 00:00:00"), ts("2024-01-10 00:00:00"))
    seen = pixels.pixel_visits(log, homes, ("5", ""), window)
    assert seen.count() == 2 and pixels.pixel_visits(log, homes, ("", ""), window).count() == 0
    found = pixels.exposed_visits(log.where("event_type = 'impression'"), seen)
    assert rows(found, F.col("conversion_ts").cast("string"), "is_first", F.col("hit.ts").cast("string")) == [
        ("2024-01-09 02:00:00", True, "2024-01-09 01:00:00"), ("2024-01-09 03:00:00", False, "2024-01-09 01:00:00"),
    ]


def test_lift_rates(spark):
    shown = spark.createDataFrame([("US", 1, 9), ("US", 1, 9), ("US", 2, 9), ("US", 3, 8)], "country string, device_id int, placement int")
    used = spark.createDataFrame([("US", 1, 4), ("US", 5, 2)], "country string, device_id int, hours int")
    devices = spark.createDataFrame([(i, "US") for i in range(1, 11)], "device_id int, country string")
    got = lift.lift_by(shown, used, devices, ("placement",)).first()
    assert (got.placement, got.reach, got.imps, got.exposed_users, got.total_users, got.universe) == (9, 2, 3, 1, 2, 10)
    assert got.exposed_rate == 0.5 and got.unexposed_rate == 1 / 8 and got.lift == 3 and got.lift_hours == 1
    by_freq = {r.frequency: r.reach for r in lift.lift_by(shown, used, devices, (), 20).collect()}
    assert by_freq == {2: 1}
    nobody = lift.overall_lift(devices, devices, shown.limit(0), used.limit(0), used.limit(0)).first()
    assert nobody.reach == 0 and nobody.frequency is None and nobody.lift is None


def test_lift_of_two_countries(spark):
    """Each country is measured against its own universe, by hand."""
    shown = spark.createDataFrame(
        [("US", 1, 9, ts("2024-01-08 10:00:00")), ("US", 2, 9, ts("2024-01-08 11:00:00")), ("FR", 11, 9, ts("2024-01-08 12:00:00"))],
        "country string, device_id int, placement int, event_ts timestamp_ntz",
    )
    used = spark.createDataFrame(
        [("US", 1, 4, ts("2024-01-08 20:00:00")), ("US", 3, 2, ts("2024-01-08 20:00:00")), ("FR", 11, 6, ts("2024-01-08 20:00:00"))],
        "country string, device_id int, hours int, conversion_ts timestamp_ntz",
    )
    devices = spark.createDataFrame([(1, "US"), (2, "US"), (3, "US"), (4, "US"), (11, "FR"), (12, "FR")], "device_id int, country string")
    got = {r.country: r for r in lift.lift_by(shown, used, devices).collect()}
    us, fr = got["US"], got["FR"]
    assert (us.universe, us.reach, us.unexposed, us.exposed_rate, us.unexposed_rate, us.lift) == (4, 2, 2, 0.5, 0.5, 0)
    assert (fr.universe, fr.reach, fr.unexposed, fr.exposed_rate, fr.unexposed_rate, fr.lift) == (2, 1, 1, 1, 0, None)
    daily = {r.country: (r.universe, r.reach, r.unexposed, r.unexposed_users) for r in lift.daily_exposure(shown, used, devices).collect()}
    assert daily == {"US": (4, 2, 2, 1), "FR": (2, 1, 1, 0)}


def test_new_users_and_genres(spark):
    used = spark.createDataFrame(
        [(1, 1, ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00"), 3600), (1, 1, ts("2024-01-02 10:00:00"), ts("2024-01-02 11:00:00"), 3600),
         (2, 2, ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00"), 3600), (2, 2, ts("2024-01-03 10:00:00"), ts("2024-01-03 10:05:00"), 300)],
        "device_id int, profile_id int, conversion_ts timestamp_ntz, end_ts timestamp_ntz, seconds int",
    )
    assert rows(au.new_users(used), "profile_id") == [(1,)]
    play = lambda c, a, b: (1, c, "PROG", ts(a), ts(b))
    content = spark.createDataFrame(
        [play("7", "2024-01-01 10:00:00", "2024-01-01 10:03:00"), play("8", "2024-01-01 10:10:00", "2024-01-01 10:12:00"), play("7", "2024-01-01 10:20:00", "2024-01-01 10:24:00"),
         play("9", "2024-01-01 10:55:00", "2024-01-01 11:05:00"), play("9", "2024-01-02 10:00:00", "2024-01-02 10:06:00")],
        "profile_id int, content_id string, content_type string, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    base = au.qualified_content(used, content)
    # title 7 reaches six minutes over two stretches of one session
    assert rows(base, "content_id", "content_seconds") == [("7", 420), ("9", 360)]
    assert rows(au.new_user_audience(base), "profile_id", "content_sessions") == [(1, 2)]
    programs = spark.createDataFrame([(7, "Show", ["Football"]), (9, "Show", ["Golf", "News"]), (8, "Show", [])], "program_id int, program_type string, genres array<string>")
    titles = spark.createDataFrame([(7, "Le match", "main", "fr"), (7, "Match", "main", "en-GB"), (7, "The match", "main", "en"), (9, "Golf", "main", "en")], "program_id int, title string, title_type string, title_language string")
    assert rows(au.preferred_titles(titles), "title") == [("Golf",), ("The match",)]
    sports = au.genre_content(programs)
    assert rows(sports, "program_id") == [(7,)]
    assert au.only_genre_audience(base, sports, au.preferred_titles(titles)).count() == 0
    assert rows(au.only_genre_audience(base.where("content_id = '7'"), sports, au.preferred_titles(titles)), "event_count") == [(1,)]


def test_timesheet_rules(spark):
    raw = spark.createDataFrame(
        [("Ann ", "0", "Plan", "t", "1.5", None, "1.5"), ("Bob", "x", "Plan", "t", "0", "2", "2"), ("Cy", "x", "Plan", "t", "1", "1", "0")],
        "name string, team string, category string, task string, date_22_apr string, date_29_apr string, total string",
    )
    got = sheet.timesheet_long(raw, ("date_22_apr", "date_29_apr"), 2024, ("name", "team", "category", "task"), ("team",))
    assert rows(got, "name", "team", F.col("log_date").cast("string"), "minutes_active", "week_num") == [("Ann", "", "2024-04-22", 90.0, 1), ("Bob", "x", "2024-04-29", 120.0, 2)]
    mapping = spark.createDataFrame([(" d ", "t ", "c", "new", "Pre Sales"), ("d", "t", "c", "new", "Pre Sales"), ("d", "Town Hall / NPS x", "c", "", "Post Sales")], "department string, task string, category string, change_category string, sales_cycle string")
    clean = sheet.clean_map(mapping, (("Town Hall%NPS%", "Town Hall"),))
    assert rows(clean, "task") == [("Town Hall",), ("t",)] and sheet.ambiguous_keys(clean).count() == 0
    log = spark.createDataFrame([("d", "t", "c", "r", 5.0), ("d", "other", "c", "r", 6.0)], "department string, task string, category string, role string, minutes_active double")
    label = lambda k: spark.createDataFrame([("L", "r")], f"label string, {k} string")
    report = sheet.timesheet_report(log, clean, label("role"), label("department"))
    assert report.count() == log.count()
    assert rows(report, "category", "sales_cycle", "leadership_status", "client_facing_status") == [("c", None, "L", None), ("new", "Pre Sales", "L", None)]
    assert rows(sheet.unmatched(log, clean), "task") == [("other",)]


def test_all_other_is_strictly_below_99_percent(spark):
    report = spark.createDataFrame([("Pre Sales", "A", 99.0), ("Pre Sales", "B", 1.0), ("Post Sales", "B", 100.0), ("Pre Sales", "PTO", 50.0)], "sales_cycle string, category string, minutes_active double")
    got = sheet.cycle_categories(sheet.cycle_hours(report))
    assert rows(got, "sales_cycle", "title", F.round("percent", 3)) == [("Post Sales", "01 - % All Other", 50.0), ("Pre Sales", "01 - % All Other", 50.0)]
    wide = sheet.cycle_pivot(report, totals=True)
    assert wide.count() == 3
