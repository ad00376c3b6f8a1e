"""Ranks, ordinals and first values over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.operators import numbering, rows
from airtally.operators import timesheet as ts

from .registry import query
from .sheets import EXACT, rounded


@query(
    "ranked_tasks",
    "long_log",
    f""", s AS (SELECT category, task, {EXACT} AS m FROM long_log GROUP BY ALL)
SELECT category, task, CAST(m AS DOUBLE) AS minutes, round(CAST(m AS DOUBLE) / (SELECT CAST(sum(m) AS DOUBLE) FROM s), 6) AS share,
  row_number() OVER (ORDER BY m DESC, category, task) AS rank_by_time FROM s""",
)
def ranked_tasks(t):
    return rounded(ts.top_tasks(t.long_log(), None), "share")


@query("order_ranks", "", "SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority, o_orderdate DESC) AS place FROM orders")
def order_ranks(t):
    ranked = numbering.rank_rows(t.table("orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority", ("o_orderdate", "desc")], "place")
    return ranked.select("o_orderkey", "place")


@query(
    "session_ordinals",
    "sessions",
    "SELECT profile_id, app_id, country, start_ts, end_ts, row_number() OVER (PARTITION BY country, CAST(start_ts AS DATE) ORDER BY start_ts, profile_id, app_id, end_ts) AS ordinal FROM sessions",
)
def session_ordinals(t):
    dated = t.sessions().withColumn("day", F.to_date("start_ts"))
    return numbering.ordinals(dated, ["country", "day"], "start_ts", ["profile_id", "app_id", "end_ts"]).drop("day")


@query(
    "first_app_of_day",
    "sessions",
    "SELECT DISTINCT country, CAST(start_ts AS DATE) AS day, app_id, first_value(app_id) OVER (PARTITION BY country, CAST(start_ts AS DATE) ORDER BY start_ts, profile_id, app_id) AS first_app FROM sessions",
)
def first_app_of_day(t):
    dated = t.sessions().withColumn("day", F.to_date("start_ts"))
    return rows.first_value(dated, ["country", "day"], "app_id", ["start_ts", "profile_id", "app_id"], "first_app").select("country", "day", "app_id", "first_app").distinct()
