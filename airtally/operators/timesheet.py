"""Timesheets: wide logs to rows, re-mapping, shares and pivots.

The detail is one row per person, task and day; reports work on sums by label. Labels
(categories, tasks, teams, sales cycles) come from fixed pick lists, so the ranked and
pivoted frames below hold at most one row per combination of labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import date_lit, label_date, week_number
from ..functions.metrics import zero_label_to_blank
from ..storage import use_checkpoint_dir
from .numbering import number_rows

# Sales cycles that have their own report columns, and time off.
CYCLES = {"presales": "Pre Sales", "pre_and_post": "Pre and Post Sales", "postsales": "Post Sales"}
TIME_OFF = "PTO"


def minutes_sum(column=None, where=None):
    """Exact sum: decimals add up to the same total in whatever order tasks finish."""
    c = F.col("minutes_active") if column is None else F.col(column)
    c = c.cast("decimal(18,6)") if column is None else c
    return F.sum(c if where is None else F.when(where, c))


def as_double(column):
    return F.col(column).cast("double")


def timesheet_long(
    raw: DataFrame,
    day_columns: Sequence[str],
    year: int,
    labels: Sequence[str] = ("name", "role", "region", "vertical", "team", "sales_group", "department", "category", "task", "sales_cycle"),
    blank_zero: Sequence[str] = ("vertical", "team", "sales_group"),
    total: str = "total",
) -> DataFrame:
    """One row per person, task and day with time, in minutes, with its week number."""
    kept = raw.where(F.col(total).try_cast("double") > 0)
    hours = {c: F.col(c).try_cast("double") for c in day_columns}
    dates = {c: label_date(c, year) for c in day_columns}
    # the first day with time, from one row per wide row
    used = kept.agg(*[F.min(F.when(hours[c] > 0, date_lit(dates[c]))).alias(c) for c in day_columns])
    first = used.select(F.array_min(F.array(*day_columns)).alias("_first"))

    trimmed = kept.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in labels], *[(h * 60).alias(c) for c, h in hours.items()])
    rows = trimmed.unpivot(list(labels), list(day_columns), "_label", "minutes_active").where(F.col("minutes_active") > 0)
    day_of = F.create_map(*[x for c, d in dates.items() for x in (F.lit(c), date_lit(d))])
    rows = rows.withColumns({"log_date": day_of[F.col("_label")], **{c: zero_label_to_blank(c) for c in blank_zero}}).drop("_label")
    return rows.crossJoin(F.broadcast(first)).withColumn("week_num", week_number("_first", "log_date")).drop("_first")  # one row


def clean_map(mapping: DataFrame, task_rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Distinct trimmed map rows; ``task_rules`` (LIKE pattern, label) repair task names."""
    trimmed = mapping.select(*[F.trim(c).alias(c.strip()) for c in mapping.columns])
    if task_rules:
        task = F.col("task")
        for pattern, label in reversed(task_rules):
            task = F.when(F.col("task").like(pattern), label).otherwise(task)
        trimmed = trimmed.withColumn("task", task)
    return trimmed.distinct()


def _map_key(df: DataFrame):
    return [F.trim(df[c]) for c in ("department", "task", "category")]


def timesheet_report(log: DataFrame, mapping: DataFrame, leadership: DataFrame, client_facing: DataFrame) -> DataFrame:
    """Log with the mapped category and sales cycle and the two status labels."""
    m = mapping.select(
        F.col("department").alias("_d"), F.col("task").alias("_t"), F.col("category").alias("_c"), "change_category", F.col("sales_cycle").alias("_cycle")
    )
    d, t, c = _map_key(log)
    out = log.join(m, (F.col("_d") == d) & (F.col("_t") == t) & (F.col("_c") == c), "left")
    changed = F.coalesce("change_category", F.lit(""))
    out = out.withColumn("category", F.when(changed != "", changed).otherwise(F.col("category"))).withColumn("sales_cycle", F.col("_cycle"))
    out = out.drop("_d", "_t", "_c", "_cycle", "change_category")
    out = out.join(leadership.select("role", F.col("label").alias("leadership_status")), "role", "left")
    return out.join(client_facing.select("department", F.col("label").alias("client_facing_status")), "department", "left")


def unmatched(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """Log rows the map does not know."""
    m = mapping.select(F.col("department").alias("_d"), F.col("task").alias("_t"), F.col("category").alias("_c"))
    d, t, c = _map_key(log)
    return log.join(m, (F.col("_d") == d) & (F.col("_t") == t) & (F.col("_c") == c), "left_anti")


def ambiguous_keys(mapping: DataFrame) -> DataFrame:
    """Map keys with more than one target: they would repeat log rows."""
    return mapping.groupBy("department", "task", "category").count().where(F.col("count") > 1)


def team_sizes(report: DataFrame) -> DataFrame:
    """Report with ``team (size)`` labels; people are told apart by name and role."""
    people = report.groupBy("team").agg(F.countDistinct(F.concat("name", F.lit(" - "), "role")).alias("_n"))
    name = F.when(F.coalesce("team", F.lit("")) == "", "No Team").otherwise(F.col("team"))
    labelled = people.select("team", F.concat(name, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias("team_size_name"))
    return report.join(labelled, "team", "left")


def share_report(log: DataFrame, keys: Sequence[str], where=None) -> DataFrame:
    """Minutes by label, their share, hours and the hours of all labels together."""
    kept = log if where is None else log.where(where)
    return _shares(kept.groupBy(*keys).agg(minutes_sum().alias("_minutes")), keys)


def _shares(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    grand = sums.agg(minutes_sum("_minutes").alias("_all"))
    return sums.crossJoin(F.broadcast(grand)).select(  # one row
        *keys,
        as_double("_minutes").alias("minutes"),
        F.try_divide(as_double("_minutes"), as_double("_all")).alias("share"),
        (as_double("_minutes") / 60).alias("hours"),
        (as_double("_all") / 60).alias("grand_hours"),
    )


def top_tasks(log: DataFrame, k: int | None = 10) -> DataFrame:
    """Tasks ranked by time with their share of the total. All of them (``k=None``) are
    numbered in sorted ranges, the first ones by a limited sort."""
    sums = log.groupBy("category", "task").agg(minutes_sum().alias("_minutes"))
    shared = _shares(sums, ["category", "task"]).drop("hours", "grand_hours")
    order = [F.desc("minutes"), "category", "task"]
    if k is None:
        return number_rows(shared, order, "rank_by_time")
    return shared.orderBy(*order).limit(k).withColumn("rank_by_time", F.row_number().over(W.orderBy(*order)))


def cycle_hours(report: DataFrame, cycles: Sequence[str] = tuple(CYCLES.values()), others: bool = False, client_facing: str | None = None) -> DataFrame:
    """Hours by sales cycle and category without time off; ``others`` turns the list of
    cycles into an exclusion."""
    wanted = F.col("sales_cycle").isin(*cycles)
    kept = report.where((~wanted if others else wanted) & (F.col("category") != TIME_OFF))
    if client_facing is not None:
        kept = kept.where(F.col("client_facing_status") == client_facing)
    sums = kept.groupBy("sales_cycle", "category").agg(minutes_sum().alias("minutes"))
    return sums.withColumn("hours", as_double("minutes") / 60)


def cycle_categories(hours: DataFrame, top_percent: float = 99.0) -> DataFrame:
    """Percent of all hours per cycle and category, categories beyond the top percent of
    a cycle folded into "All Other", every cycle paired with every category."""
    upto = W.partitionBy("sales_cycle").orderBy(F.desc("minutes"), "category").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("sales_cycle")
    part = lambda a, b: 100 * F.try_divide(a.cast("double"), b.cast("double"))
    reached = part(F.sum("minutes").over(upto), F.sum("minutes").over(whole))
    named = hours.withColumn("report_category", F.when(reached < top_percent, F.col("category")).otherwise("All Other"))
    grand = hours.agg(F.sum("minutes").alias("_all"))  # one row
    header = hours.groupBy("sales_cycle").agg(F.sum("minutes").alias("_cycle")).crossJoin(F.broadcast(grand))
    header = header.select("sales_cycle", "_all", part(F.col("_cycle"), F.col("_all")).alias("cycle_percent"))

    sums = named.groupBy("sales_cycle", "report_category").agg(F.sum("minutes").alias("_minutes"))
    by_category = sums.groupBy("report_category").agg(F.sum("_minutes").alias("_category"))
    position = F.row_number().over(W.orderBy(F.desc("_category"), "report_category"))
    titled = by_category.select(
        "report_category", F.concat(F.lpad(position.cast("string"), 2, "0"), F.lit(" - % "), F.col("report_category")).alias("title")
    )
    grid = header.crossJoin(F.broadcast(titled))  # cycles x category labels: pick-list sized
    filled = grid.join(sums, ["sales_cycle", "report_category"], "left")
    return filled.select("sales_cycle", "cycle_percent", "title", F.coalesce(part(F.col("_minutes"), F.col("_all")), F.lit(0.0)).alias("percent"))


def cycle_pivot(report: DataFrame, totals: bool = False, **toggles) -> DataFrame:
    """One row per sales cycle, one numbered percent column per category.

    Column names come from the data. The report is read once, here: its hours by cycle and
    category are checkpointed, a row for each pair of labels, and all that follows is made
    of these.
    """
    use_checkpoint_dir(report.sparkSession)
    shares = cycle_categories(cycle_hours(report, **toggles).checkpoint())
    by_title = F.map_from_entries(F.collect_list(F.struct("title", "percent"))).alias("_percents")
    rows = shares.groupBy("sales_cycle", "cycle_percent").agg(by_title).checkpoint()
    titles = sorted(r[0] for r in rows.select(F.explode(F.map_keys("_percents"))).distinct().collect())
    pivoted = rows.select("sales_cycle", "cycle_percent", *[F.col("_percents")[F.lit(t)].alias(t) for t in titles])
    if totals:
        total = pivoted.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in pivoted.columns if c != "sales_cycle"])
        pivoted = pivoted.unionByName(total.withColumn("sales_cycle", F.lit("Total")))
    return pivoted


def department_hours(report: DataFrame, weeks: int = 4, days: int = 20) -> DataFrame:
    """Hours per department: total, per member and per sales cycle, with weekly and
    daily averages. Members and sums by condition come from one pass."""
    cycle, worked = F.col("sales_cycle"), F.col("category") != TIME_OFF
    picks = {name: cycle == value for name, value in CYCLES.items()}
    picks["other"] = ~cycle.isin(*CYCLES.values())
    hours = report.groupBy("department").agg(
        F.countDistinct(F.concat("name", F.lit(" - "), "role")).alias("members"),
        F.count_if(worked).alias("_worked"),
        (minutes_sum(where=worked).cast("double") / 60).alias("total_hours"),
        *[(minutes_sum(where=worked & cond).cast("double") / 60).alias(f"{name}_hours") for name, cond in picks.items()],
    )
    # departments with nothing but time off have no row
    out = hours.where("_worked > 0").drop("_worked").withColumn("hours_per_member", F.try_divide("total_hours", "members"))
    for name in picks:
        total, member = F.col(f"{name}_hours"), F.try_divide(f"{name}_hours", "members")
        out = (
            out.withColumn(f"{name}_per_member", member)
            .withColumn(f"{name}_weekly", total / weeks)
            .withColumn(f"{name}_daily", total / days)
            .withColumn(f"{name}_per_member_weekly", member / weeks)
            .withColumn(f"{name}_per_member_daily", member / days)
        )
    return out
