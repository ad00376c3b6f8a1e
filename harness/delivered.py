"""Runs that deliver: what readers of the delivered files and refreshed tables see."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from airtally.plans.run import Inputs, run_report
from airtally.plans.weekly import REPORT_COLUMNS
from airtally.sinks.commits import read_delivered, replace_table
from airtally.sinks.reports import Destinations
from airtally.storage import new_folder

from .registry import also, query
from .reports import round_weekly
from .tables import AS_OF, CONFIG


@also("report_files", "weekly_report")
def report_files(t):
    """The weekly report run from its arguments to files, and read back as the receiver does."""
    root = new_folder(t.spark, "delivery")
    destinations = Destinations(f"{root}/home", f"{root}/abroad", f"{root}/home_copy", f"{root}/abroad_copy")
    cfg = replace(CONFIG, partner="Test", max_rows=300, receipts="Y")
    mapping = t.mapping().withColumn("last_update_ts", F.lit(AS_OF).cast("timestamp_ntz"))
    inputs = Inputs(t.delivery(), t.sessions(), mapping, t.order_meta(), t.profile_map())
    _, copied = run_report(inputs, cfg, destinations, "EU")
    types = dict(t.weekly_types())
    delivered = read_delivered(t.spark, f"{root}/abroad_copy", ", ".join(f"{c} {types[c]}" for c in REPORT_COLUMNS), number=copied.number)
    return round_weekly(delivered)


@query("refreshed_table", "", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def refreshed_table(t):
    """A table that is fully refreshed twice: what is there is the last refresh, and only that."""
    orders = t.table("orders")
    root = new_folder(t.spark, "refreshed")
    name = f"refreshed_{root.rsplit('-', 1)[-1]}"
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    for status in ("F", "O"):
        replace_table(orders.where(F.col("o_orderstatus") == status).select(*columns), name, root)
    out = t.spark.table(name).select(*columns)
    t.spark.sql(f"DROP TABLE {name}")  # the frame knows its files
    return out
