"""Ranks and ordinals of ranges and slices against windows over everything; intervals as aligned nodes."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airtally.operators import numbering as nb
from airtally.operators import rows as rw
from airtally.operators.timesheet import top_tasks

from .conftest import rows, ts
from .test_reports import gathered, plan_of


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("values", [[1, 1, 1, 1, None], [None, 1, 2, 3, 5, 8], [4]])
def test_ranks_with_ties_over_ranges(spark, many_ranges, values):
    rnd = random.Random(len(values))
    df = spark.createDataFrame([(rnd.choice(values), rnd.randrange(2), i) for i in range(400)], "k int, j int, i int")
    for order, window in ((["k"], W.orderBy("k")), ([("k", "desc"), "j"], W.orderBy(F.desc("k"), "j"))):
        assert rows(nb.rank_rows(df, order)) == rows(df.withColumn("rank", F.rank().over(window)))
    assert nb.rank_rows(df.limit(0), ["k"]).count() == 0


def test_ordinals_over_slices(spark):
    rnd = random.Random(4)
    stamps = [ts(f"2024-01-0{rnd.randrange(1, 4)} {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:00") for _ in range(300)]
    df = spark.createDataFrame([(rnd.choice(["US", "US", None]), at, i) for i, at in enumerate(stamps)], "country string, at timestamp_ntz, i int")
    wanted = df.withColumn("ordinal", F.row_number().over(W.partitionBy("country").orderBy("at", "i")))
    for seconds in (60, 3600, 10**6):
        assert rows(nb.ordinals(df, ["country"], "at", ["i"], slice_seconds=seconds)) == rows(wanted)


def test_first_value(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), ("b", 1, None)], "k string, o int, v string")
    assert rows(rw.first_value(df, ["k"], "v", ["o"], "f"), "k", "o", "f") == [(None, 5, "z"), ("a", 1, "y"), ("a", 2, "y"), ("b", 1, None)]


def test_nodes_cover_exactly(spark):
    rnd = random.Random(5)
    spans = [(a, a + rnd.choice([0, 1, 2, 7, 8, 63, 500])) for a in (rnd.randrange(-600, 600) for _ in range(60))]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", rw.dyadic_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        covered = [x for n in r.n for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1)) and len(r.n) <= 20


def test_a_session_of_24_years_is_some_40_rows(spark):
    outer = spark.createDataFrame([(1, ts("2000-01-01 00:30:00"), ts("2024-01-01 00:30:00"))], "p int, o0 timestamp_ntz, o1 timestamp_ntz")
    bin_of = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    assert outer.select(F.size(rw.dyadic_nodes(bin_of("o0"), bin_of("o1"))).alias("n")).first().n <= 40
    inner = spark.createDataFrame([(1, ts(f"{y}-06-01 12:00:00"), ts(f"{y}-06-01 13:00:00")) for y in range(1998, 2027)], "p int, i0 timestamp_ntz, i1 timestamp_ntz")
    assert rw.contained_in(inner, outer, ["p"], ("i0", "i1"), ("o0", "o1")).count() == 24


def test_ranking_all_tasks_gathers_nothing(spark):
    log = spark.createDataFrame([(f"c{i % 7}", f"t{i}", float(i % 50)) for i in range(300)], "category string, task string, minutes_active double")
    every, some = top_tasks(log, None), top_tasks(log, 10)
    assert rows(every.where("rank_by_time <= 10"), "task", "rank_by_time") == rows(some, "task", "rank_by_time")
    # the one row of all minutes, and one row per range
    assert all("Aggregate" in x or "Window" in x or "_range" in x for x in gathered(plan_of(every)))


def test_pivot_has_no_cap_and_reads_the_log_once(spark):
    from airtally.operators.timesheet import cycle_pivot

    reads = spark.sparkContext.accumulator(0)
    made = [("Pre Sales", f"c{i:04d}", 1.0 + i) for i in range(600)] + [("Post Sales", "PTO", 5.0), ("Post Sales", "c0001", 7.0)]

    def counted(batches):
        reads.add(1)
        yield from batches

    log = spark.createDataFrame(made, "sales_cycle string, category string, minutes_active double").coalesce(1).mapInArrow(counted, "sales_cycle string, category string, minutes_active double")
    out = cycle_pivot(log, totals=True)
    got = {r.sales_cycle: r for r in out.collect()}
    assert set(got) == {"Pre Sales", "Post Sales", "Total"} and len(out.columns) > 502
    assert abs(sum(v for k, v in got["Total"].asDict().items() if k not in ("sales_cycle", "cycle_percent")) - 100) < 1e-6
    assert reads.value == 1
    assert cycle_pivot(log.limit(0)).count() == 0


def test_days_of_a_device_meet_on_device_and_day(spark):
    from airtally.plans.weekly_v1 import instant_opens, opens_by_usage_day

    log = spark.createDataFrame([(1, "US", ts("2024-01-01 10:00:00"), 5, 6)], "device_id int, country string, event_ts timestamp_ntz, creative_id int, campaign_id int")
    usage = spark.createDataFrame([(1, "US", ts("2024-01-03 10:00:00"), 9)], "device_id int, country string, conversion_ts timestamp_ntz, minutes long")
    for out in (opens_by_usage_day(log, usage), instant_opens(log, usage, ("creative_id",))):
        assert rows(out, "date", "creative_id", "openers", "minutes") == [(ts("2024-01-03 00:00:00").date(), 5, 1, 9)]
        plan = plan_of(out)
        # days meet on device and day; on the device alone only its first and last day are looked up
        joins = re.findall(r"Join \[(device_id#[^\]]*)\]", plan)
        assert "Generate explode(sequence" in plan and any("date#" in keys for keys in joins)
        assert sum("date#" not in keys for keys in joins) <= 1


def test_medians_from_counts(spark):
    from airtally.operators.curves import conversion_medians, grain_medians

    rnd = random.Random(8)
    made = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(5), rnd.randrange(10**6), 1023, 1024]), rnd.randrange(1, 4)) for _ in range(300)]
    df = spark.createDataFrame(made, "k string, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    wanted = df.withColumn("x", F.explode(F.expr("sequence(1, n)"))).groupBy("k").agg(F.median("v").alias("m"))
    for bucket in (1, 7, 1024, 10**9):
        assert rows(grain_medians(df, ["k"], "v", "n", "m", bucket)) == rows(wanted)

    stamps = [ts(f"2024-01-0{rnd.randrange(1, 5)} 10:00:00") for _ in range(200)]
    log = spark.createDataFrame([(rnd.randrange(40), rnd.choice(["p", "q"]), at, rnd.randrange(1, 9), rnd.choice([None, rnd.randrange(600_000)])) for at in stamps], "device_id int, placement string, first_exposure timestamp_ntz, exposures long, seconds_to_convert long")
    dated = log.withColumn("day", F.to_date("first_exposure"))
    measures = [F.median("exposures"), F.median("seconds_to_convert") / 3600, F.countDistinct("device_id")]
    by = {"DAY": dated.groupBy("day", "placement").agg(*measures), "PLACEMENT": dated.groupBy("placement").agg(F.min("day"), *measures), "TOTAL UNIQUE": dated.groupBy().agg(F.min("day"), *measures)}
    order = {"DAY": (0, 1, 2, 3, 4), "PLACEMENT": (1, 0, 2, 3, 4), "TOTAL UNIQUE": None}
    expected = []
    for grain, frame in by.items():
        for r in frame.collect():
            r = (r[0], "ALL", *r[1:]) if order[grain] is None else tuple(r[i] for i in order[grain])
            expected.append((grain, *r))
    round6 = lambda x: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x]
    assert sorted(round6(map(tuple, conversion_medians(log).collect())), key=str) == sorted(round6(expected), key=str)
    assert conversion_medians(log.limit(0)).count() == 0
