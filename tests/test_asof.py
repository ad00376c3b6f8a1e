"""The linear lookups against all pairs, with slices of several lengths."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airtally.operators.asof import asof, day_lookup
from airtally.operators.attribution import attribute, credit_once, nearest_exposure, sessions_after
from airtally.operators.curves import exposures_to_convert
from airtally.plans.weekly_v1 import instant_opens, opens_by_usage_day, opens_total

from .conftest import rows, ts

DAY0 = datetime(2024, 1, 1)


def random_log(seed, n, devices=3, creatives=3, days=6):
    """Few devices and instants, so that ties and busy keys occur; some null devices."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        device = None if r.random() < 0.1 else r.choice([0, 0, 0, *range(devices)])
        at = DAY0 + timedelta(days=r.randrange(days), hours=r.randrange(0, 24, 6), seconds=r.choice([0, 0, 59, 61]))
        out.append((i, device, at, r.randrange(creatives)))
    return out


SCHEMA = "event_id int, device_id int, event_ts timestamp_ntz, creative_id int"


def frames(spark, seed, n=70, m=40):
    e, c = random_log(seed, n), random_log(seed + 100, m)
    exposures = spark.createDataFrame(e, SCHEMA)
    conversions = spark.createDataFrame(c, SCHEMA).select(
        F.col("event_id").alias("cid"), "device_id", F.col("event_ts").alias("conversion_ts"), (F.col("creative_id") + 1).alias("minutes")
    )
    return e, c, exposures, conversions


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_row_matches_all_pairs(spark, seed, slice_seconds):
    e, c, exposures, conversions = frames(spark, seed)
    back = asof(conversions, exposures, ["device_id"], "conversion_ts", "event_ts", ("creative_id",), ("event_id",), {"n": F.lit(1)}, slice_seconds=slice_seconds)
    expected = []
    for cid, dev, at, _ in c:
        before = [(t, i) for i, d, t, _ in e if dev is not None and d == dev and t <= at]
        if before:
            expected.append((cid, max(before)[1], len(before)))
    assert rows(back, "cid", F.col("hit.event_id"), "n") == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))

    ahead = asof(exposures, conversions.withColumn("k", F.col("cid")), ["device_id"], "event_ts", "conversion_ts", (), ("k",), {"s": F.col("minutes")}, "forward", slice_seconds=slice_seconds)
    expected = []
    for i, dev, at, _ in e:
        after = [(t, cid, m + 1) for cid, d, t, m in c if dev is not None and d == dev and t >= at]
        if after:
            expected.append((i, min(after)[1], sum(x[2] for x in after)))
    assert rows(ahead, "event_id", F.col("hit.k"), "s") == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))


def test_left_keeps_every_row(spark):
    _, c, exposures, conversions = frames(spark, 5)
    out = asof(conversions, exposures, ["device_id"], "conversion_ts", "event_ts", sums={"n": F.lit(1)}, how="left")
    assert out.count() == len(c)
    assert out.where("hit is null and n <> 0").count() == 0
    assert out.where("device_id is null and hit is not null").count() == 0


@pytest.mark.parametrize("touch", ["last", "first"])
@pytest.mark.parametrize("window", [0, 2, None])
@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_attribution_matches_all_pairs(spark, touch, window, slice_seconds):
    e, c, exposures, conversions = frames(spark, 11)
    found = attribute(exposures, conversions, ["device_id"], touch, window, carry=("creative_id",), tiebreak=("event_id",), slice_seconds=slice_seconds)
    expected = []
    for cid, dev, at, _ in c:
        ok = [(t, i) for i, d, t, _ in e if dev is not None and d == dev and t <= at and (window is None or (at.date() - t.date()).days <= window)]
        if ok:
            expected.append((cid, (max if touch == "last" else min)(ok)[1]))
    assert rows(found, "cid", F.col("hit.event_id")) == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))


def test_window_edges(spark):
    """Same instant counts, the seventh day counts, the eighth does not; the largest id wins a tie."""
    exposures = spark.createDataFrame(
        [(1, 1, ts("2024-01-08 10:00:00"), 1), (2, 1, ts("2024-01-08 10:00:00"), 2), (3, 2, ts("2024-01-01 23:59:59"), 1), (4, 3, ts("2024-01-01 00:00:00"), 1)], SCHEMA
    )
    conversions = spark.createDataFrame(
        [(1, ts("2024-01-08 10:00:00")), (2, ts("2024-01-08 00:00:01")), (3, ts("2024-01-09 00:00:00"))], "device_id int, conversion_ts timestamp_ntz"
    )
    found = attribute(exposures, conversions, ["device_id"], "last", 7, tiebreak=("event_id",))
    assert rows(found, "device_id", F.col("hit.event_id")) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("seed", [21, 22])
def test_credit_once_matches_all_pairs(spark, seed):
    e, c, exposures, usage = frames(spark, seed)
    got = credit_once(exposures, usage, ["device_id"], 1, ("creative_id",))
    expected = {}
    for cid, dev, at, m in c:
        for creative in {x for _, d, t, x in e if dev is not None and d == dev and 0 <= (at.date() - t.date()).days <= 1}:
            minutes, sessions = expected.get((dev, creative), (0, 0))
            expected[dev, creative] = minutes + m + 1, sessions + 1
    assert {(r.device_id, r.creative_id): (r.minutes, r.sessions) for r in got.collect()} == expected


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_pair_counts_and_nearest(spark, slice_seconds):
    e, c, exposures, usage = frames(spark, 31)
    after = sessions_after(exposures, usage, ["device_id"], slice_seconds=slice_seconds)
    pairs = [(i, cid) for i, d, t, _ in e for cid, d2, t2, _ in c if d is not None and d == d2 and t <= t2]
    assert after.agg(F.sum("sessions_after")).first()[0] == len(pairs)

    firsts = usage.withColumnRenamed("conversion_ts", "first_ts")
    near = nearest_exposure(exposures, firsts, carry=("creative_id",), slice_seconds=slice_seconds)
    best = {}
    for _, d, t, cr in e:
        for _, d2, t2, _ in c:
            if d is not None and d == d2 and t <= t2:
                key = (int((t2 - t).total_seconds()), t, cr, t2)
                best[d] = min(best.get(d, key), key)
    assert {r.device_id: (r.gap_seconds, r.event_ts, r.creative_id, r.first_ts) for r in near.collect()} == best


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_exposures_to_convert_matches_all_pairs(spark, slice_seconds):
    e, c, exposures, usage = frames(spark, 41, 60)
    placed = exposures.withColumn("placement", F.col("creative_id"))
    got = exposures_to_convert(placed, usage, 2, slice_seconds=slice_seconds)
    expected = {}
    for d in {x[1] for x in e if x[1] is not None}:
        for p in range(3):
            led = {}
            for _, dev, t, cr in e:
                if dev == d and cr == p:
                    ok = [t2 for _, d2, t2, _ in c if d2 == d and t <= t2 and (t2.date() - t.date()).days <= 2]
                    if ok:
                        led[t] = min(ok)
            if led:
                first, conv = min(led), min(led.values())
                expected[d, p] = (first, conv, sum(first <= t <= conv for t in led))
    assert {(r.device_id, r.placement): (r.first_exposure, r.first_conversion, r.exposures) for r in got.collect()} == expected


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**9])
def test_repeated_time_matches_all_pairs(spark, slice_seconds):
    e, c, exposures, usage = frames(spark, 51)
    got = instant_opens(exposures, usage, ("creative_id",), slice_seconds=slice_seconds)
    minutes, openers = {}, {}
    for _, d, t, cr in e:
        for _, d2, t2, m in c:
            if d is not None and d == d2 and t <= t2:
                key = (t2.date(), cr)
                minutes[key] = minutes.get(key, 0) + m + 1
                openers.setdefault(key, set()).add(d)
    assert {(r.date, r.creative_id): (r.openers, r.minutes) for r in got.collect()} == {k: (len(openers[k]), v) for k, v in minutes.items()}


def test_usage_day_tables_match_all_pairs(spark):
    e, c, exposures, usage = frames(spark, 61)
    tag = lambda df: df.withColumn("country", F.lit("x"))
    exposures, usage = tag(exposures).withColumn("campaign_id", F.lit(1)), tag(usage)
    days = {(d, t.date(), cr) for _, d, t, cr in e if d is not None}
    spent = {}
    for _, d, t, m in c:
        if d is not None:
            spent[d, t.date()] = spent.get((d, t.date()), 0) + m + 1
    by_day, total = {}, {}
    for (d, used), m in spent.items():
        for cr in range(3):
            times = sum(1 for d2, shown, c2 in days if d2 == d and c2 == cr and shown <= used)
            if times:
                devices, minutes = by_day.get((used, cr), (0, 0))
                by_day[used, cr] = devices + 1, minutes + m * times
                total.setdefault(cr, {})[d, used] = m
    got = opens_by_usage_day(exposures, usage)
    assert {(r.date, r.creative_id): (r.openers, r.minutes) for r in got.collect()} == by_day
    whole = opens_total(exposures, usage)
    assert {r.creative_id: (r.openers, r.minutes) for r in whole.collect()} == {k: (len({d for d, _ in v}), sum(v.values())) for k, v in total.items()}


def test_day_lookup_range(spark):
    left = spark.sql("select 1 as k, date'2024-01-05' as d union all select 1, date'2024-01-09' union all select null, date'2024-01-05'")
    right = spark.sql("select 1 as k, date'2024-01-03' as r, 5 as v union all select 1, date'2024-01-05', 7")
    out = day_lookup(left, right, ["k"], "d", "r", {"s": F.sum("v")}, -2, 0)
    assert rows(out, "k", F.col("d").cast("string"), "s") == [(None, "2024-01-05", None), (1, "2024-01-05", 12), (1, "2024-01-09", None)]


def test_both_levels_read_one_shuffle(spark):
    _, _, exposures, conversions = frames(spark, 3)
    found = asof(conversions, exposures, ["device_id"], "conversion_ts", "event_ts", ("creative_id",), sums={"n": F.lit(1)})
    out = found.select("cid", "hit.creative_id", "n")  # a report reads some of the columns only
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1
