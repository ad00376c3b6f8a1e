"""The test tables seen as delivery logs, sessions, mappings and so on.

``views.py`` states the same bindings in SQL.
"""

from __future__ import annotations

from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.config import ReportConfig
from airtally.functions.dates import between_ts
from airtally.functions.predicates import not_dropped
from airtally.operators.usage import app_usage, usage_in

START, END, AS_OF = date(2024, 1, 8), date(2024, 1, 21), date(2024, 1, 24)
CONFIG = ReportConfig(
    as_of=AS_OF,
    start=START,
    end=END,
    attribution_days=7,
    pixel_lookback_days=7,
    signup_segment="0",
    homepage_segment="1",
    min_session_seconds=3600,
)
WINDOWS = CONFIG.windows()

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

KINDS = {"view": "impression", "click": "click", "error": "tracker", "signup": "segment"}
TRACKERS = ("start", "first_quartile", "midpoint", "third_quartile", "complete")


def minutes_later(ts: str, minutes) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.round(minutes * 60_000_000).cast("bigint"), F.col(ts))


def once(method):
    """Build a frame once per ``Tables``: its files are listed and analysed once."""

    @wraps(method)
    def built(self, *args, **kw):
        key = (method.__name__, args, tuple(sorted(kw.items())))
        if key not in self._built:
            self._built[key] = method(self, *args, **kw)
        return self._built[key]

    return built


def once_for(fn):
    """The same for a function of the tables."""

    @wraps(fn)
    def built(t):
        if fn.__name__ not in t._built:
            t._built[fn.__name__] = fn(t)
        return t._built[fn.__name__]

    return built


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._built: dict = {}

    @once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    @once
    def devices(self) -> DataFrame:
        """Device and country, from the customer list."""
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("device_id"), F.col("n_name").alias("country"), "c_mktsegment", "n_nationkey", "n_regionkey"
        )

    @once
    def events(self, *kinds: str) -> DataFrame:
        """Raw events of the given kinds with country and payload id ``k``."""
        raw = self.table("events").where(F.col("event_type").isin(*kinds))
        raw = raw.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumnRenamed("user_id", "device_id")
        return raw.join(self.devices().select("device_id", "country"), "device_id")

    @once
    def creatives(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("creative_id"),
            F.col("p_name").alias("creative_name"),
            F.col("p_brand").alias("campaign_id"),
            F.col("p_size").alias("flight_id"),
            F.col("p_type").alias("placement"),
        )

    @once
    def delivery(self, *kinds: str) -> DataFrame:
        """Ad log. ``kinds`` restricts the raw event types, so the filter reaches the scan."""
        kinds = kinds or tuple(KINDS)
        ev = self.events(*kinds)
        named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        tracker = F.element_at(F.array(*map(F.lit, TRACKERS)), (F.col("k") % 5 + 1).cast("int"))
        log = ev.select(
            "event_id",
            "device_id",
            F.expr("device_id div 3").alias("household_id"),
            "country",
            F.col("ts").alias("event_ts"),
            named[F.col("event_type")].alias("event_type"),
            F.col("k").alias("creative_id"),
            F.when(F.col("event_type") == "signup", (F.col("k") % 2).cast("string")).alias("segment_id"),
            F.when(F.col("event_type") == "error", tracker).alias("tracker"),
            F.when(F.col("value") >= 150, True).when(F.col("value") >= 75, False).alias("dropped"),
            (F.col("k") % 7).alias("exchange_id"),
            (F.col("k") % 10 + 80).alias("exchange_seller_id"),
        )
        return log.join(self.creatives(), "creative_id")

    @once
    def impressions(self) -> DataFrame:
        return self._in_window("view")

    @once
    def clicks(self) -> DataFrame:
        return self._in_window("click")

    @once
    def _in_window(self, *kinds: str) -> DataFrame:
        log = self.delivery(*kinds).where(not_dropped())
        return log.where(between_ts("event_ts", WINDOWS.report_start, WINDOWS.report_end))

    @once
    def exposures(self) -> DataFrame:
        return self._in_window("view", "click")

    @once
    def sessions(self) -> DataFrame:
        ev = self.events("purchase")
        return ev.select(
            F.col("device_id").alias("profile_id"),
            F.col("k").alias("app_id"),
            "country",
            F.col("ts").alias("start_ts"),
            minutes_later("ts", F.col("value")).alias("end_ts"),
        )

    @once
    def profile_map(self) -> DataFrame:
        """Some profiles have no device."""
        known = self.table("customer").where(F.col("c_mktsegment") != "FURNITURE")
        return known.select(F.col("c_custkey").alias("profile_id"), F.col("c_custkey").alias("device_id"))

    @once
    def usage(self, min_seconds: int = 3600, **kw) -> DataFrame:
        window = (WINDOWS.lookback_start, WINDOWS.report_end)
        return app_usage(self.sessions(), self.profile_map(), window=window, min_seconds=min_seconds, **kw)

    @once
    def usage_in(self, **kw) -> DataFrame:
        return usage_in(self.usage(**kw), WINDOWS.report_start, WINDOWS.report_end)

    @once
    def content(self) -> DataFrame:
        types = {"view": "PROG", "click": "VOD", "error": "OTT_PROG", "signup": "OTT_AD"}
        named = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
        return self.events(*types).select(
            F.col("device_id").alias("profile_id"),
            F.col("k").cast("string").alias("content_id"),
            named[F.col("event_type")].alias("content_type"),
            F.col("ts").alias("start_ts"),
            minutes_later("ts", F.col("value") / 60).alias("end_ts"),
            "country",
        )

    @once
    def programs(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("program_id"),
            (F.col("p_size") % 5).alias("season_number"),
            F.col("p_type").alias("program_type"),
            F.split("p_name", " ").alias("genres"),
        )

    @once
    def titles(self) -> DataFrame:
        """Two titles per programme, the English one under a regional or plain tag."""
        p = self.table("part")
        main = p.select(F.col("p_partkey").alias("program_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("en-GB").alias("title_language"))
        other = p.select(F.col("p_partkey").alias("program_id"), F.concat_ws(" ", "p_brand", "p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, "en").otherwise("fr").alias("title_language"))
        return main.unionByName(other).withColumn("title_type", F.lit("main"))

    @once
    def market(self, *segments: str) -> DataFrame:
        return self.table("customer").where(F.col("c_mktsegment").isin(*segments)).select(F.col("c_custkey").alias("device_id"))

    @once
    def regions(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("country_name"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"), F.col("r_name").alias("region")
        )

    @once
    def order_meta(self) -> DataFrame:
        """Sales order lines with prices and booked amounts."""
        size = F.col("p_size")
        day0 = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
        return self.table("part").select(
            F.substring("p_brand", 7, 2).cast("int").alias("advertiser_id"),
            F.col("p_brand").alias("advertiser_name"),
            size.alias("order_code"),
            (size + 1000).alias("sales_order_id"),
            F.concat(F.lit("Order, "), size.cast("string")).alias("sales_order_name"),
            F.lit("2024-01-01").cast("date").alias("order_start"),
            F.lit("2024-03-31").cast("date").alias("order_end"),
            F.col("p_partkey").alias("line_item_id"),
            F.concat(F.col("p_type"), F.when(size % 13 == 0, " make_good").otherwise(", standard")).alias("line_item_name"),
            F.timestamp_add("DAY", size % 25, day0).alias("line_item_start"),
            F.timestamp_add("DAY", size % 25 + 20, day0).alias("line_item_end"),
            F.when(size % 3 == 0, "CPM").when(size % 3 == 1, "Flat Rate").otherwise("Other").alias("cost_type"),
            F.col("p_retailprice").alias("net_unit_cost"),
            (F.col("p_retailprice") * 10).alias("net_cost"),
            F.when(size % 11 == 0, 1).otherwise(0).alias("is_added_value"),
            F.col("p_retailprice").alias("added_value_amount"),
            F.when(size % 4 != 0, size * 100).alias("production_quantity"),
            F.col("p_type").alias("product_name"),
            F.when(size % 25 == 0, "USA").otherwise(F.concat(F.lit("NATION_"), (size % 25).cast("string"))).alias("country_targeting"),
        )

    @once
    def mapping(self) -> DataFrame:
        """Creative mapping: the (country, creative) pairs seen in the log."""
        seen = self.events("view", "click").select("country", F.col("k").alias("creative_id")).distinct()
        o = self.order_meta().withColumn("creative_id", F.col("line_item_id"))
        named = self.creatives().select("creative_id", "creative_name", "campaign_id", "flight_id")
        return seen.join(named, "creative_id").join(o, "creative_id").select(
            F.col("country").alias("mapping_country"),
            "order_code",
            "advertiser_id",
            "advertiser_name",
            F.col("sales_order_name").alias("insertion_order_name"),
            "campaign_id",
            F.col("campaign_id").alias("campaign_name"),
            F.col("order_start").alias("campaign_start_date"),
            F.col("order_end").alias("campaign_end_date"),
            "flight_id",
            F.concat(F.lit("Flight "), F.col("flight_id").cast("string")).alias("flight_name"),
            F.col("line_item_start").alias("flight_start_date"),
            F.col("line_item_end").alias("flight_end_date"),
            "line_item_id",
            "line_item_name",
            "creative_id",
            "creative_name",
            F.col("cost_type").alias("rate_type"),
            F.col("net_unit_cost").alias("rate"),
            F.when(F.col("is_added_value") == 1, F.col("added_value_amount")).otherwise(F.col("net_cost")).alias("booked_budget"),
            F.coalesce("production_quantity", F.lit(0)).alias("placement_impressions_booked"),
            "product_name",
            F.col("line_item_start").alias("line_item_start_ts"),
            F.col("line_item_end").alias("line_item_end_ts"),
            F.col("line_item_start").alias("last_update_ts"),
        )

    @once
    def creative_map(self) -> DataFrame:
        """Country, campaign, creative, names: what the older reports map."""
        seen = self.events("view", "click").select("country", F.col("k").alias("creative_id")).distinct()
        return seen.join(self.creatives(), "creative_id").select(
            "country", "campaign_id", "creative_id", "creative_name", F.col("placement").alias("placement_name")
        )

    @once
    def wide_log(self) -> DataFrame:
        """Line items as a wide timesheet: three day columns, hours in text."""
        l, s, n, r = self.table("lineitem"), self.table("supplier"), self.table("nation"), self.table("region")
        who = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        text = lambda c: F.col(c).cast("string")
        return l.join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("s_name").alias("name"),
            F.concat(F.lit("Role "), (F.col("s_suppkey") % 4).cast("string")).alias("role"),
            F.col("r_name").alias("region"),
            F.when(F.col("n_nationkey") % 3 == 0, "0").otherwise(F.col("n_name")).alias("team"),
            F.concat(F.lit(" "), F.col("r_name"), F.lit(" ")).alias("department"),
            F.col("l_returnflag").alias("category"),
            F.concat(F.lit("Task "), text("l_linenumber")).alias("task"),
            F.col("l_linestatus").alias("sales_cycle"),
            text("l_quantity").alias("date_22_apr"),
            text("l_discount").alias("date_1_may"),
            text("l_tax").alias("date_14_may"),
            text("l_discount").alias("total"),
        )

    @once
    def long_log(self) -> DataFrame:
        from airtally.operators.timesheet import timesheet_long

        labels = ("name", "role", "region", "team", "department", "category", "task", "sales_cycle")
        return timesheet_long(self.wide_log(), ("date_22_apr", "date_1_may", "date_14_may"), 2024, labels, ("team",))

    @once
    def task_map(self) -> DataFrame:
        """Re-map of (department, category, task), from the suppliers' regions."""
        l, s, n, r = self.table("lineitem"), self.table("supplier"), self.table("nation"), self.table("region")
        by_region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        seen = l.join(by_region, F.col("l_suppkey") == F.col("s_suppkey")).select("l_returnflag", "l_linenumber", "r_regionkey", "r_name").distinct()
        pairs = seen.where(F.col("l_linenumber") != F.col("r_regionkey") + 1)  # the map has gaps
        cycle = F.when(F.col("l_linenumber") % 3 == 0, "Pre Sales").when(F.col("l_linenumber") % 3 == 1, "Post Sales").otherwise("Pre and Post Sales")
        return pairs.select(
            F.col("r_name").alias("department"),
            cycle.alias("sales_cycle"),
            F.col("l_returnflag").alias("category"),
            F.when(F.col("l_linenumber") == 2, "PTO").when(F.col("l_linenumber") == 5, "Meetings").otherwise("").alias("change_category"),
            F.concat(F.lit("Task "), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("task"),
        )

    def weekly_types(self) -> list[tuple[str, str]]:
        """Columns and types of the weekly report."""
        from airtally.plans import mapping as mp
        from airtally.plans.weekly import REPORT_COLUMNS, weekly_report

        mapping = mp.enrich_mapping(self.mapping(), self.order_meta())
        return weekly_report(self.delivery(), self.sessions(), mapping, self.profile_map(), CONFIG).select(*REPORT_COLUMNS).dtypes

    @once
    def sheet_report(self) -> DataFrame:
        from airtally.operators.timesheet import clean_map, timesheet_report

        roles = self.table("supplier").select(F.concat(F.lit("Role "), (F.col("s_suppkey") % 4).cast("string")).alias("role")).distinct()
        leadership = roles.where(F.col("role") != "Role 3").withColumn("label", F.when(F.col("role") == "Role 0", "Lead").otherwise("Member"))
        facing = self.table("region").select(F.when(F.col("r_regionkey") < 3, "Client Facing").otherwise("Internal").alias("label"), F.col("r_name").alias("department"))
        return timesheet_report(self.long_log(), clean_map(self.task_map()), leadership, facing)
