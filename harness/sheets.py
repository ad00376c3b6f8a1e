"""Timesheet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.operators import timesheet as ts

from .registry import query


# decimal sums do not depend on the order of the rows
EXACT = "sum(CAST(minutes_active AS DECIMAL(18, 6)))"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("timesheet_long", "long_log", "SELECT name, role, region, team, department, category, task, sales_cycle, log_date, round(minutes_active, 6) AS minutes_active, week_num FROM long_log")
def timesheet_long(t):
    return rounded(t.long_log(), "minutes_active")


@query("timesheet_remap", "sheet_report", "SELECT name, role, department, category, task, sales_cycle, log_date, round(minutes_active, 6) AS minutes_active, leadership_status, client_facing_status FROM sheet_report")
def remap(t):
    out = t.sheet_report().select("name", "role", "department", "category", "task", "sales_cycle", "log_date", "minutes_active", "leadership_status", "client_facing_status")
    return rounded(out, "minutes_active")


@query(
    "timesheet_unmatched",
    "long_log task_map",
    """SELECT t.department, t.task, t.category, count(*) AS rows FROM long_log t LEFT JOIN task_map m ON m.department = t.department AND m.task = t.task AND m.category = t.category
WHERE m.task IS NULL GROUP BY ALL""",
)
def unmatched(t):
    left = ts.unmatched(t.long_log(), ts.clean_map(t.task_map()))
    return left.groupBy("department", "task", "category").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "team_sizes",
    "sheet_report",
    """, n AS (SELECT team, count(DISTINCT name || ' - ' || role) AS c FROM sheet_report GROUP BY 1)
SELECT r.team, r.name, n2.label AS team_size_name, count(*) AS rows FROM sheet_report r
LEFT JOIN (SELECT team, CASE WHEN coalesce(team, '') = '' THEN 'No Team' ELSE team END || ' (' || c || ')' AS label FROM n) n2 ON n2.team = r.team GROUP BY ALL""",
)
def team_sizes(t):
    return ts.team_sizes(t.sheet_report()).groupBy("team", "name", "team_size_name").agg(F.count(F.lit(1)).alias("rows"))


def _share_sql(keys: str, where: str = "") -> str:
    return f""", s AS (SELECT {keys}, {EXACT} AS m FROM long_log {where} GROUP BY ALL), a AS (SELECT CAST(sum(m) AS DOUBLE) AS total FROM s)
SELECT {keys}, CAST(m AS DOUBLE) AS minutes, round(CAST(m AS DOUBLE) / total, 6) AS share, CAST(m AS DOUBLE) / 60 AS hours, total / 60 AS grand_hours FROM s, a"""


def _share(t, keys, where=None):
    return rounded(ts.share_report(t.long_log(), keys, where), "share")


@query("share_by_category", "long_log", _share_sql("category"))
def share_by_category(t):
    return _share(t, ["category"])


@query("share_by_task", "long_log", _share_sql("category, task", "WHERE category = 'R'"))
def share_by_task(t):
    return _share(t, ["category", "task"], F.col("category") == "R")


@query("share_by_cycle", "long_log", _share_sql("sales_cycle"))
def share_by_cycle(t):
    return _share(t, ["sales_cycle"])


@query(
    "top_tasks",
    "long_log",
    f""", s AS (SELECT category, task, {EXACT} AS m FROM long_log GROUP BY ALL),
r AS (SELECT category, task, CAST(m AS DOUBLE) AS minutes, CAST(m AS DOUBLE) / (SELECT CAST(sum(m) AS DOUBLE) FROM s) AS share, row_number() OVER (ORDER BY m DESC, category, task) AS rank_by_time FROM s)
SELECT category, task, minutes, round(share, 6) AS share, CAST(rank_by_time AS INTEGER) AS rank_by_time FROM r WHERE rank_by_time <= 10""",
)
def top_tasks(t):
    return rounded(ts.top_tasks(t.long_log(), 10), "share")


CYCLES = "('Pre Sales', 'Pre and Post Sales', 'Post Sales')"
# Running sums over a cycle's categories decide which are folded; the grid of cycles and labels is
# filled from the folded sums, and labels are numbered by their sums.
SHARES = f""", spent AS (SELECT sales_cycle, category, {EXACT} AS m FROM sheet_report WHERE sales_cycle IN {CYCLES} AND category <> 'PTO' GROUP BY ALL),
running AS (SELECT *, sum(m) OVER (PARTITION BY sales_cycle ORDER BY m DESC, category) AS upto, sum(m) OVER (PARTITION BY sales_cycle) AS whole, sum(m) OVER () AS grand FROM spent),
folded AS (SELECT sales_cycle, whole, grand, if(100 * (CAST(upto AS DOUBLE) / CAST(whole AS DOUBLE)) < 99, category, 'All Other') AS label, sum(m) AS m FROM running GROUP BY ALL),
labels AS (SELECT label, row_number() OVER (ORDER BY sum(m) DESC, label) AS place FROM folded GROUP BY label),
shares AS (SELECT c.sales_cycle, round(100 * (CAST(whole AS DOUBLE) / CAST(grand AS DOUBLE)), 6) AS cycle_percent, place, format('{{:02d}} - % {{}}', place, label) AS title,
    round(coalesce(100 * (CAST(f.m AS DOUBLE) / CAST(c.grand AS DOUBLE)), 0), 6) AS percent
  FROM (SELECT DISTINCT sales_cycle, whole, grand FROM folded) c CROSS JOIN labels LEFT JOIN (SELECT sales_cycle, label, m FROM folded) f USING (sales_cycle, label))
"""


@query("cycle_shares", "sheet_report", SHARES + "SELECT sales_cycle, cycle_percent, title, percent FROM shares")
def cycle_shares(t):
    return rounded(ts.cycle_categories(ts.cycle_hours(t.sheet_report())), "cycle_percent", "percent")


#: Columns that the pivot is compared in: the pick lists give fewer labels than this.
SLOTS = 8


def _pivot_sql(shares: str = SHARES, totals: bool = False) -> str:
    slots = ", ".join(f"max(title) FILTER (place = {i}) AS title_{i}, sum(percent) FILTER (place = {i}) AS percent_{i}" for i in range(1, SLOTS + 1))
    total = f" UNION ALL SELECT 'Total', (SELECT sum(cycle_percent) FROM (SELECT DISTINCT sales_cycle, cycle_percent FROM shares)), {slots} FROM shares HAVING count(*) > 0" if totals else ""
    wide = f"SELECT sales_cycle, cycle_percent, {slots} FROM shares GROUP BY sales_cycle, cycle_percent{total}"
    # sums of rounded percents only agree to fewer digits
    rounded_ = ", ".join(f"title_{i}, round(percent_{i}, 4) AS percent_{i}" for i in range(1, SLOTS + 1))
    return f"{shares} SELECT sales_cycle, round(cycle_percent, 4) AS cycle_percent, {rounded_} FROM ({wide})"


def _slots(out):
    """The pivot's numbered columns by position: the title as a column of its own."""
    titles = [c for c in out.columns if c not in ("sales_cycle", "cycle_percent")]
    named = [(F.lit(titles[i]), F.round(F.col(f"`{titles[i]}`"), 4)) if i < len(titles) else (F.lit(None).cast("string"), F.lit(None).cast("double")) for i in range(max(SLOTS, len(titles)))]
    columns = [c for i, (title, percent) in enumerate(named, 1) for c in (title.alias(f"title_{i}"), percent.alias(f"percent_{i}"))]
    return out.select("sales_cycle", F.round("cycle_percent", 4).alias("cycle_percent"), *columns)


@query("cycle_pivot", "sheet_report", _pivot_sql())
def cycle_pivot(t):
    return _slots(ts.cycle_pivot(t.sheet_report()))


@query("cycle_pivot_totals", "sheet_report", _pivot_sql(totals=True))
def cycle_pivot_totals(t):
    return _slots(ts.cycle_pivot(t.sheet_report(), totals=True))


@query(
    "cycle_pivot_client_facing",
    "sheet_report",
    _pivot_sql(SHARES.replace("category <> 'PTO'", "category <> 'PTO' AND client_facing_status = 'Client Facing'"), totals=True),
)
def cycle_pivot_client_facing(t):
    return _slots(ts.cycle_pivot(t.sheet_report(), totals=True, client_facing="Client Facing"))


@query("cycle_pivot_others", "sheet_report", _pivot_sql(SHARES.replace(f"sales_cycle IN {CYCLES}", "sales_cycle NOT IN ('Pre Sales')")))
def cycle_pivot_others(t):
    return _slots(ts.cycle_pivot(t.sheet_report(), cycles=("Pre Sales",), others=True))


def _hours_sql() -> str:
    names = {"presales": "sales_cycle = 'Pre Sales'", "pre_and_post": "sales_cycle = 'Pre and Post Sales'", "postsales": "sales_cycle = 'Post Sales'", "other": f"sales_cycle NOT IN {CYCLES}"}
    sums = ", ".join(f"CAST(sum(CASE WHEN {c} THEN CAST(minutes_active AS DECIMAL(18, 6)) END) AS DOUBLE) / 60 AS {n}_hours" for n, c in names.items())
    out = ", ".join(
        f"{n}_hours, {n}_hours / members AS {n}_per_member, {n}_hours / 4 AS {n}_weekly, {n}_hours / 20 AS {n}_daily, "
        f"{n}_hours / members / 4 AS {n}_per_member_weekly, {n}_hours / members / 20 AS {n}_per_member_daily"
        for n in names
    )
    return f""", m AS (SELECT department, count(DISTINCT name || ' - ' || role) AS members FROM sheet_report GROUP BY 1),
h AS (SELECT department, CAST({EXACT} AS DOUBLE) / 60 AS total_hours, {sums} FROM sheet_report WHERE category <> 'PTO' GROUP BY 1)
SELECT department, members, total_hours, total_hours / members AS hours_per_member, {out} FROM h LEFT JOIN m USING (department)"""


@query("department_hours", "sheet_report", _hours_sql())
def department_hours(t):
    return ts.department_hours(t.sheet_report())
