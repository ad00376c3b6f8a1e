"""What readers get from files that the sinks or a partner wrote, and options of sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from airtally.operators import delivery as d
from airtally.operators import rows
from airtally.operators.usage import app_usage
from airtally.sinks import reports as sinks
from airtally.sources import files as src
from airtally.storage import new_folder

from .registry import query
from .tables import WINDOWS
from .views import WINDOW


@query("id_list_sessions", "sessions", "SELECT s.* FROM sessions s WHERE profile_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def id_list_sessions(t):
    """A first-party list of ids, with blanks around them and empty lines, as an audience."""
    path = new_folder(t.spark, "ids")
    listed = t.market("MACHINERY").select(F.concat(F.lit("  "), F.col("device_id").cast("string"), F.lit(" ")).alias("profile_id"))
    listed.union(t.spark.range(3).select(F.lit(" "))).write.options(header=True).csv(path)
    return rows.semi(t.sessions(), src.read_id_list(t.spark, path, dtype="bigint"), ["profile_id"])


@query("csv_folders", "", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_folders(t):
    """All files below a folder, a folder for each region."""
    path = new_folder(t.spark, "folders")
    t.table("nation").withColumn("r", F.col("n_regionkey")).write.options(header=True).partitionBy("r").csv(path)
    return src.read_csv_dir(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("typed_mapping", "", "SELECT p_partkey AS placement_id, CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS TIMESTAMP) AS camp_start, CAST(DATE '2024-03-01' + CAST(p_size AS INTEGER) AS TIMESTAMP) AS camp_end FROM part")
def typed_mapping(t):
    """Dates as a mapping file has them, typed; columns marked for deletion go."""
    text = lambda start: F.date_format(F.date_add(F.lit(start), F.col("p_size")), "M/d/yyyy")
    raw = t.table("part").select(F.col("p_partkey").alias("placement_id"), text(date(2024, 1, 1)).alias("camp_start"), text(date(2024, 3, 1)).alias("camp_end"), F.lit(1).alias("delete_country"))
    return src.clean_mapping(raw)


@query(
    "written_report",
    "",
    "SELECT o_orderkey, o_orderpriority || ', \"x\"' AS priority, CAST(ceil(row_number() OVER (ORDER BY o_orderdate, o_orderkey) / 4000) AS INTEGER) AS file FROM orders",
)
def written_report(t):
    """A report in files of 4,000 rows, with the number in each file's name."""
    folder = new_folder(t.spark, "report")
    report = t.table("orders").withColumn("priority", F.concat("o_orderpriority", F.lit(', "x"')))
    sinks.write_report(report, folder, lambda i: f"orders_{i:03d}.csv", ("o_orderdate", "o_orderkey"), ("o_orderkey", "priority"), date(2024, 1, 24), 4000)
    read = t.spark.read.schema("o_orderkey bigint, priority string").options(header=True, quote='"', escape='"').csv(folder)
    return read.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.csv", 1).cast("int"))


@query("table_folders", "", "SELECT DATE '2024-01-24' AS report_exec_date, r_regionkey, r_name FROM region")
def table_folders(t):
    paths = sinks.write_tables({"regions": t.table("region")}, new_folder(t.spark, "tables"), date(2024, 1, 24))
    return t.spark.read.schema("report_exec_date date, r_regionkey int, r_name string").options(header=True).csv(paths["regions"])


@query("untyped_copy", "", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def untyped_copy(t):
    folder = new_folder(t.spark, "copy")
    t.table("customer").select("c_custkey", "c_name").write.options(**sinks.CSV_FORMAT).csv(f"{folder}/source")
    sinks.copy_csv(t.spark, f"{folder}/source", f"{folder}/target", ("c_custkey", "c_name"))
    return t.spark.read.schema("c_custkey string, c_name string").options(header=True).csv(f"{folder}/target")


@query("named_app_usage", "sessions", "SELECT s.profile_id, s.country, s.start_ts FROM sessions s WHERE s.app_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR p_brand = 'Brand#7')")
def named_app_usage(t):
    """Sessions of the apps that have a name exactly."""
    meta = t.table("part").select(F.col("p_partkey").alias("app_id"), F.col("p_brand").alias("app_name"))
    apps = rows.audience_or(*(src.app_ids(meta, name=n) for n in ("Brand#12", "Brand#7")))
    return rows.semi(t.sessions(), apps, ["app_id"]).select("profile_id", "country", "start_ts")


@query("deduped_usage", "usage", "SELECT device_id, profile_id, country, conversion_ts, end_ts, minutes FROM usage")
def deduped_usage(t):
    """A log that repeats every session: the repeats are dropped before time is added up."""
    window = (WINDOWS.lookback_start, WINDOWS.report_end)
    return app_usage(t.sessions().union(t.sessions()), t.profile_map(), window=window, min_seconds=3600, dedupe=True).select(
        "device_id", "profile_id", "country", "conversion_ts", "end_ts", "minutes"
    )


@query("all_clicks", "delivery", f"SELECT campaign_id, count(*) AS clicks FROM delivery WHERE event_type = 'click' AND event_ts {WINDOW} GROUP BY 1")
def all_clicks(t):
    """Clicks as they are, dropped ones included."""
    log = t.delivery("click").where(F.col("event_ts").between(F.lit(WINDOWS.report_start), F.lit(WINDOWS.report_end)))
    return d.split_delivery(log, drop_clicks_too=False)["clicks"].groupBy("campaign_id").agg(F.count(F.lit(1)).alias("clicks"))
