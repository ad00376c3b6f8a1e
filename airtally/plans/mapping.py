"""Campaign metadata and the creative mapping table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import add_months, day_end, day_start
from ..functions.dates import between_ts, ts_lit, ts_of
from ..functions.metrics import booked_budget, decoded_country, product_prefix
from ..functions.predicates import active_in, not_dropped
from ..operators.delivery import CREATIVE_KEYS
from ..operators.rows import latest_per_key, semi


class StaleMapping(RuntimeError):
    """The mapping is too old to report on."""


def campaign_meta(
    opportunities: DataFrame,
    sales_orders: DataFrame,
    order_lines: DataFrame,
    campaigns: DataFrame,
    campaign_attrs: DataFrame,
    order_codes: DataFrame,
    products: DataFrame | None = None,
    window: tuple[datetime, datetime] | None = None,
    attrs_order_key: str = "order_external_id",
    earliest: bool = False,
) -> DataFrame:
    """Order codes to orders, campaigns and lines, each in its latest version.

    ``attrs_order_key`` names the attribute that holds the order id (sources differ);
    ``earliest`` takes the first version of orders and lines instead. ``window`` keeps
    lines active in it; ``products`` adds the product and its name prefix.
    """
    version = ["modified_ts", "version_id"]
    opp = latest_per_key(semi(opportunities, order_codes, ["order_code"]), ["order_code"], version)
    opp = opp.select("order_code", "campaign_ref", "sales_order_id", "order_name")
    wanted = opp.select("sales_order_id")
    orders = latest_per_key(semi(sales_orders, wanted, ["sales_order_id"]), ["sales_order_id"], version, earliest)
    orders = orders.select("sales_order_id", F.col("start_date").alias("order_start"), F.col("end_date").alias("order_end"))
    lines = latest_per_key(semi(order_lines, wanted, ["sales_order_id"]), ["line_id"], version, earliest)
    lines = lines.select(
        "sales_order_id",
        "line_id",
        F.col("name").alias("line_name"),
        ts_of("start_date", "start_time").alias("line_start"),
        ts_of("end_date", "end_time").alias("line_end"),
        *(["product_id"] if products is not None else []),
    )
    if products is not None:
        lines = lines.join(products.select("product_id", "product_name", product_prefix("product_name").alias("product")), "product_id", "left")
    attrs = campaign_attrs.withColumn("_order", F.col(attrs_order_key)).select("campaign_id", "rate_type", "net_unit_cost", F.col("order_external_id").alias("sales_order_id"), F.col("line_external_id").alias("line_id"), "_order")
    attrs = semi(attrs, wanted.withColumnRenamed("sales_order_id", "_order"), ["_order"]).drop("_order").distinct()
    sold = attrs.join(
        campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"), F.col("start_ts").alias("campaign_start"), F.col("end_ts").alias("campaign_end")),
        "campaign_id",
    )
    out = opp.join(orders, "sales_order_id").join(sold, "sales_order_id").join(lines, ["sales_order_id", "line_id"])
    if window:
        out = out.where(active_in("line_start", "line_end", *map(ts_lit, window), closed=True))
    return out.distinct()


def with_creatives(meta: DataFrame, campaign_creatives: DataFrame, flights: DataFrame, creatives: DataFrame) -> DataFrame:
    """Flight and creative names of the observed (campaign, flight, creative) combinations."""
    combos = campaign_creatives.select("campaign_id", "flight_id", "creative_id").distinct()
    named = combos.join(flights.select(F.col("id").alias("flight_id"), F.col("name").alias("flight_name"), F.col("start_ts").alias("flight_start"), F.col("end_ts").alias("flight_end")), "flight_id", "left")
    named = named.join(creatives.select(F.col("id").alias("creative_id"), F.col("name").alias("creative_name")), "creative_id", "left")
    return meta.join(named, "campaign_id")


def creative_map(mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    return mapping.select(*columns).distinct()


def refresh_window(as_of: date, months: int = 3) -> tuple[datetime, datetime]:
    """From the earlier of ``months`` ago and the start of the quarter, to yesterday."""
    quarter = date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1)
    return day_start(min(add_months(as_of, -months), quarter)), day_end(as_of - timedelta(days=1))


def refresh_creative_map(
    orders: DataFrame,
    campaigns: DataFrame,
    campaign_attrs: DataFrame,
    campaign_creatives: DataFrame,
    delivery: DataFrame,
    flights: DataFrame,
    creatives: DataFrame,
    regions: DataFrame,
    advertisers: DataFrame,
    as_of: date,
    updated: datetime | None = None,
) -> DataFrame:
    """Advertisers' orders with the countries, flights and creatives seen in deliveries.

    The delivery log is reduced to its distinct combinations before it meets any
    dimension. An order line is paired with every flight and creative of its campaign.
    """
    start, end = refresh_window(as_of)
    sold = semi(orders, advertisers, ["advertiser_id"])
    lines = campaign_attrs.select("campaign_id", F.col("order_external_id").alias("sales_order_id"), F.col("line_external_id").alias("line_item_id")).distinct()
    live = campaigns.where(F.col("state") != "archived").select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    codes = sold.select("sales_order_id", "order_code").distinct()
    ordered = live.join(lines, "campaign_id").join(codes, "sales_order_id")
    combos = campaign_creatives.select("campaign_id", "flight_id", "creative_id").distinct()

    observed = delivery.where(
        F.col("event_type").isin("impression", "click", "tracker") & F.col("country").isNotNull() & not_dropped() & between_ts("event_ts", start, end)
    )
    seen = semi(observed.select(*CREATIVE_KEYS).distinct(), combos, ["campaign_id", "flight_id", "creative_id"])
    seen = seen.join(ordered.select("order_code", "campaign_id").distinct(), "campaign_id")

    names = creatives.select(F.col("id").alias("creative_id"), F.col("name").alias("creative_name")).distinct()
    flight = flights.select(F.col("id").alias("flight_id"), "campaign_id", F.col("name").alias("flight_name"), F.col("start_ts").alias("flight_start"), F.col("end_ts").alias("flight_end"))
    region = regions.select(F.col("country_name").alias("country_targeting"), "country_code", "region")
    line_campaign = ordered.select("line_item_id", "campaign_id", "campaign_name").distinct()
    base = sold.where(
        F.col("order_code").isNotNull()
        & (F.col("sales_order_name") != "")
        & (F.col("line_item_end") >= ts_lit(start))
        & (F.col("line_item_start") <= ts_lit(end))
    ).join(line_campaign, "line_item_id")
    out = (
        base.join(seen, ["order_code", "campaign_id"], "left")
        .join(names, "creative_id", "left")
        .join(region, "country_targeting", "left")
        .join(flight, ["flight_id", "campaign_id"], "left")
    )
    return out.select(
        "advertiser_id",
        "advertiser_name",
        "country_targeting",
        "country",
        decoded_country("country_targeting", "country_code").alias("mapping_country"),
        F.coalesce("region", F.lit("")).alias("region"),
        "order_code",
        F.col("sales_order_name").alias("insertion_order_name"),
        "campaign_id",
        "campaign_name",
        F.col("order_start").alias("campaign_start_date"),
        F.col("order_end").alias("campaign_end_date"),
        "flight_id",
        "flight_name",
        F.col("flight_start").alias("flight_start_date"),
        F.col("flight_end").alias("flight_end_date"),
        "line_item_id",
        "line_item_name",
        F.col("line_item_start").alias("line_item_start_ts"),
        F.col("line_item_end").alias("line_item_end_ts"),
        "creative_id",
        "creative_name",
        F.col("cost_type").alias("rate_type"),
        F.col("net_unit_cost").alias("rate"),
        booked_budget("is_added_value", "added_value_amount", "net_cost").alias("booked_budget"),
        F.coalesce("production_quantity", F.lit(0)).alias("placement_impressions_booked"),
        F.lit(0.0).alias("budget_delivered"),
        "product_name",
        ts_lit(updated or day_start(as_of)).alias("last_update_ts"),
    ).distinct()


def enrich_mapping(mapping: DataFrame, orders: DataFrame) -> DataFrame:
    """Mapping rows with the added-value flag of their order line."""
    flags = orders.select("order_code", "line_item_id", "is_added_value")
    return mapping.join(flags, ["order_code", "line_item_id"], "left")


def mapping_age(mapping: DataFrame, as_of: date) -> DataFrame:
    """Days since the newest mapping row."""
    newest = mapping.agg(F.max("last_update_ts").alias("last_update_ts"))
    return newest.withColumn("age_days", F.datediff(F.lit(as_of), "last_update_ts"))


def assert_fresh(mapping: DataFrame, as_of: date, max_days: int = 7) -> DataFrame:
    """The mapping itself; raises when its newest row is ``max_days`` old or older."""
    age = mapping_age(mapping, as_of).first().age_days
    if age is not None and age >= max_days:
        raise StaleMapping(f"mapping was last updated {age} days ago")
    return mapping
