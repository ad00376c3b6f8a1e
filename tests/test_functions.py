from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from airtally import config as cfg
from airtally.functions import dates as d
from airtally.functions import metrics as m
from airtally.functions import predicates as p

from .conftest import rows, ts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def at(text):
    return d.ts_lit(ts(text))


@pytest.mark.parametrize(
    "unit, start, end, expected",
    [
        ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:01", 1),
        ("minute", "2024-01-01 00:00:00", "2024-01-01 00:00:59", 0),
        ("second", "2024-01-01 00:00:00.9", "2024-01-01 00:00:01.1", 1),
        ("hour", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1),
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1),
        ("minute", "2024-01-01 00:01:00", "2024-01-01 00:00:59", -1),
    ],
)
def test_differences_count_boundaries(spark, unit, start, end, expected):
    assert one(spark, d.diff(unit, at(start), at(end))) == expected


def test_dates(spark):
    assert one(spark, d.label_to_date(F.lit("MINUTES_1_MAY"), 2024)) == date(2024, 5, 1)
    assert one(spark, d.label_to_date(F.lit("minutes_22_apr"), 2024)) == date(2024, 4, 22)
    assert d.label_date("date_1_may", 2024) == date(2024, 5, 1)
    assert one(spark, d.epoch_ts(F.lit(1704067200.9))) == datetime(2024, 1, 1)
    assert one(spark, d.ts_of(F.lit(date(2024, 1, 2)), F.lit("06:30:00"))) == datetime(2024, 1, 2, 6, 30)
    assert one(spark, d.ts_of(F.lit(date(2024, 1, 2)), F.lit(None).cast("string"))) is None
    assert one(spark, d.hour_key_to_ts(F.lit("2024010823"))) == datetime(2024, 1, 8, 23)
    assert one(spark, d.week_number(F.lit(date(2024, 4, 22)), F.lit(date(2024, 4, 29)))) == 2
    assert d.quarter_or_earlier(date(2024, 5, 20), date(2024, 4, 20)) == date(2024, 4, 1)


def test_windows():
    c = cfg.ReportConfig(as_of=date(2024, 3, 31), lookback_months=1)
    w = c.windows()
    assert (w.report_start, w.report_end) == (datetime(2024, 3, 1), datetime(2024, 3, 31, 23, 59, 59))
    assert w.lookback_start == datetime(2024, 2, 1) and w.pixel_start == datetime(2024, 1, 31)
    assert w.attribution_end == datetime(2024, 4, 7, 23, 59, 59)
    assert cfg.add_months(date(2024, 3, 31), -1) == date(2024, 2, 29)
    # a Monday, a Sunday
    assert cfg.weekly_window(date(2024, 1, 15)) == (date(2024, 1, 8), date(2024, 1, 14))
    assert cfg.weekly_window(date(2024, 1, 14)) == (date(2024, 1, 8), date(2024, 1, 14))
    assert cfg.monthly_window(date(2024, 3, 15)) == (date(2024, 2, 1), date(2024, 3, 14))
    assert cfg.blackout_window(date(2023, 11, 22)) == (datetime(2023, 5, 21, 23, 59, 59), datetime(2023, 11, 21, 23, 59, 59))
    assert cfg.required_window(date(2023, 11, 22), date(2023, 11, 28), 7)[1] == datetime(2023, 12, 5, 23, 59, 59)


def test_predicates(spark):
    flags = spark.createDataFrame([(True,), (False,), (None,)], "dropped boolean")
    assert rows(flags.where(p.not_dropped())) == [(None,), (False,)]
    span = (at("2024-01-01 00:00:00"), at("2024-01-01 00:01:00"))
    assert one(spark, p.min_duration(*span, 60)) and not one(spark, p.min_duration(*span, 60, inclusive=False))
    assert not one(spark, p.id_in(F.lit(7), ["", None])) and one(spark, p.id_in(F.lit(7), [" 7 "]))
    assert one(spark, p.exclude_patterns(F.lit(None).cast("string"), ["%a%"]))
    assert not one(spark, p.exclude_patterns(F.lit("Drama|News"), ["%news%"]))
    assert one(spark, p.is_make_good(F.lit("Line make good 1"))) and not one(spark, p.is_make_good(F.lit("makegood")))
    assert one(spark, p.is_make_good(F.lit("makegood"), any_spelling=True))
    start, end = at("2024-01-10 00:00:00"), at("2024-01-20 00:00:00")
    window = (at("2024-01-01 00:00:00"), at("2024-01-10 00:00:00"))
    assert not one(spark, p.active_in(start, end, *window)) and one(spark, p.active_in(start, end, *window, closed=True))


def test_cost_rules_first_match_wins(spark):
    lines = spark.createDataFrame(
        [("a make_good", 1, "CPM", 2.0), ("b", 1, "CPM", 2.0), ("c", 0, "CPM", 2.0), ("d", 0, "Flat Rate", 2.0), ("e", None, "Other", 2.0)],
        "line string, av int, kind string, rate double",
    ).withColumn("booked", F.lit(99.0)).withColumn("imps", F.lit(500))
    out = lines.select("line", m.budget_delivered("line", "av", "kind", "imps", "rate", "booked").alias("cost"))
    assert rows(out) == [("a make_good", 0.0), ("b", 0.0), ("c", 1.0), ("d", 99.0), ("e", None)]


def test_ratios_guard_zero(spark):
    zero, some = F.lit(0), F.lit(4)
    assert one(spark, m.ctr(zero, zero)) == 0 and one(spark, m.ctr(F.lit(1), some)) == 0.25
    assert one(spark, m.cpc(F.lit(8.0), zero)) == 0 and one(spark, m.cpc(F.lit(None).cast("double"), some)) is None
    assert one(spark, m.frequency(zero, zero)) == 0 and one(spark, m.frequency(some, zero)) is None
    assert one(spark, m.ttc_bucket(F.lit(3))) == "03" and one(spark, m.ttc_bucket(F.lit(15))) == "15+"
    assert one(spark, m.freq_bucket(F.lit(21))) == 20
    assert one(spark, m.product_prefix(F.lit("Native – Banner - X"))) == "Native "
    ranks = [one(spark, m.language_rank(F.lit(x))) for x in ("en", "en-GB", "fr")]
    assert ranks == sorted(ranks)
    as_of = F.lit(date(2024, 1, 15))
    assert one(spark, m.is_fully_attributed(F.lit(date(2024, 1, 8)), as_of, 7)) == "No"
    assert one(spark, m.is_fully_attributed(F.lit(date(2024, 1, 7)), as_of, 7)) == "Yes"
