"""Delivery log, pixel, mapping and source queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from airtally.functions import dates as dt
from airtally.functions import metrics as m
from airtally.functions import predicates as p
from airtally.operators import attribution as a
from airtally.operators import delivery as d
from airtally.operators import pixels as px
from airtally.operators import rows, usage
from airtally.plans import mapping as mp
from airtally.sources.files import app_ids, split_param

from .registry import query
from .tables import END, START, WINDOWS
from .views import WINDOW


@query(
    "delivery_stats",
    "exposures",
    """SELECT CAST(event_ts AS DATE) AS date_of_exposure, country, campaign_id, flight_id, creative_id,
  count(*) FILTER (event_type = 'impression') AS impressions, count(DISTINCT device_id) FILTER (event_type = 'impression') AS reach
FROM exposures WHERE event_type = 'impression' GROUP BY ALL""",
)
def stats(t):
    return d.impressions_and_reach(t.impressions())


@query(
    "video_tiles",
    "tracker",
    """SELECT CAST(event_ts AS DATE) AS date_of_exposure, country, campaign_id, flight_id, creative_id,
  CAST(sum(CASE WHEN tracker = 'start' THEN 1 END) AS BIGINT) AS video_start, CAST(sum(CASE WHEN tracker = 'first_quartile' THEN 1 END) AS BIGINT) AS video_25,
  CAST(sum(CASE WHEN tracker = 'midpoint' THEN 1 END) AS BIGINT) AS video_50, CAST(sum(CASE WHEN tracker = 'third_quartile' THEN 1 END) AS BIGINT) AS video_75,
  CAST(sum(CASE WHEN tracker = 'complete' THEN 1 END) AS BIGINT) AS video_completions FROM tracker GROUP BY ALL""",
)
def tiles(t):
    return d.video_tiles(t._in_window("error"))


@query(
    "imps_and_clicks",
    "exposures",
    """, i AS (SELECT CAST(event_ts AS DATE) AS date, creative_id, placement, count(*) AS impressions FROM (SELECT DISTINCT device_id, event_ts, creative_id, placement FROM exposures WHERE event_type = 'impression') GROUP BY ALL),
c AS (SELECT CAST(event_ts AS DATE) AS date, creative_id, placement, count(*) AS clicks FROM (SELECT DISTINCT device_id, event_ts, creative_id, placement FROM exposures WHERE event_type = 'click') GROUP BY ALL)
SELECT i.*, coalesce(c.clicks, 0) AS clicks FROM i LEFT JOIN c USING (date, creative_id, placement)""",
)
def side_by_side(t):
    return d.imps_and_clicks(t.impressions(), t.clicks(), ["creative_id", "placement"])


@query(
    "adhoc_counts",
    "impressions usage",
    "SELECT (SELECT count(*) FROM impressions WHERE creative_id IN (3, 14, 15, 92, 65)) AS impressions, (SELECT count(DISTINCT device_id) FROM usage) AS app_users",
)
def adhoc(t):
    return d.adhoc_counts(t.impressions(), t.usage(), (3, 14, 15, 92, 65))


@query(
    "device_spread",
    "exposures usage",
    """, f AS (SELECT country, device_id, CAST(min(conversion_ts) AS DATE) AS first_open FROM usage WHERE device_id IS NOT NULL GROUP BY 1, 2)
SELECT e.device_id, e.country, count(*) AS impressions, CAST(min(e.event_ts) AS DATE) AS first_exposure, CAST(max(e.event_ts) AS DATE) AS last_exposure, f.first_open
FROM exposures e JOIN f ON f.device_id = e.device_id AND f.country = e.country GROUP BY e.device_id, e.country, f.first_open
HAVING date_diff('day', min(e.event_ts), max(e.event_ts)) >= 7 AND CAST(min(e.event_ts) AS DATE) <= f.first_open""",
)
def spread(t):
    firsts = a.first_use(t.usage().where(F.col("device_id").isNotNull()), ["country", "device_id"])
    return d.device_spread(t.exposures(), firsts, ["device_id", "country"])


@query("app_usage", "usage", "SELECT device_id, profile_id, country, conversion_ts, end_ts, minutes FROM usage")
def app_usage_query(t):
    return t.usage().select("device_id", "profile_id", "country", "conversion_ts", "end_ts", "minutes")


@query(
    "app_usage_by_name",
    "sessions profile_map",
    """SELECT m.device_id, s.profile_id, s.country, s.start_ts AS conversion_ts, CAST(sum(date_diff('second', s.start_ts, s.end_ts)) AS BIGINT) AS seconds
FROM sessions s LEFT JOIN profile_map m USING (profile_id) WHERE date_diff('second', s.start_ts, s.end_ts) > 60
  AND s.app_id IN (SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%') GROUP BY ALL""",
)
def app_usage_by_name(t):
    apps = app_ids(t.table("part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("app_name")), like="RING")
    used = usage.app_usage(t.sessions(), t.profile_map(), apps, None, min_seconds=60, inclusive=False, dedupe=False, unit="second", name="seconds")
    return used.drop("end_ts")


@query("installs_by_day", "usage", """, f AS (SELECT device_id, country, min(CAST(conversion_ts AS DATE)) AS date FROM usage GROUP BY 1, 2)
SELECT country, date, count(device_id) AS installs FROM f GROUP BY 1, 2""")
def installs_by_day(t):
    return usage.installs(t.usage())


def _active_sql(grain: str) -> str:
    g = "country, date" if grain else "country"
    return f""", f AS (SELECT device_id, country, min(CAST(conversion_ts AS DATE)) AS date FROM usage GROUP BY 1, 2),
n AS (SELECT {g}, count(device_id) AS new_users FROM f WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY ALL),
a AS (SELECT {g}, count(DISTINCT device_id) AS active_users FROM (SELECT *, CAST(conversion_ts AS DATE) AS date FROM usage) WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY ALL)
SELECT a.*, n.new_users, a.active_users - n.new_users AS returning_users FROM a LEFT JOIN n USING ({g})"""


@query("active_users", "usage", _active_sql(""))
def active(t):
    return usage.active_users(t.usage(), START, END)


@query("active_users_daily", "usage", _active_sql("date"))
def active_daily(t):
    return usage.active_users(t.usage(), START, END, daily=True)


def pixel_parts(t):
    log = t.delivery("view", "click", "signup")
    seen = log.where(dt.between_ts("event_ts", WINDOWS.pixel_start, WINDOWS.report_end))
    households = px.household_map(seen, t.profile_map())
    return households, px.pixel_visits(log, households, ("0", "1"), (WINDOWS.pixel_start, WINDOWS.report_end))


@query("household_map", "households", "SELECT household_id, device_id, profile_id FROM households")
def household_query(t):
    return pixel_parts(t)[0].select("household_id", "device_id", "profile_id")


@query("pixel_visits", "pixels", "SELECT household_id, country, segment_id, conversion_ts, device_id FROM pixels")
def pixel_query(t):
    return pixel_parts(t)[1]


@query("first_pixel_visits", "pixels", f"SELECT household_id, country, segment_id, min(conversion_ts) AS first_ts FROM pixels GROUP BY ALL HAVING min(conversion_ts) {WINDOW}")
def first_pixels(t):
    return px.first_visits(pixel_parts(t)[1]).where(dt.between_ts("first_ts", WINDOWS.report_start, WINDOWS.report_end))


@query(
    "first_pixel_visits_by_day",
    "pixels",
    """, f AS (SELECT device_id, segment_id, min(conversion_ts) AS first_ts FROM pixels GROUP BY 1, 2)
SELECT CAST(first_ts AS DATE) AS date, segment_id, count(device_id) AS visits FROM f GROUP BY 1, 2""",
)
def first_pixels_by_day(t):
    return px.first_visits_by_day(pixel_parts(t)[1])


@query(
    "exposed_visits",
    "impressions pixels",
    """, once AS (SELECT DISTINCT household_id, country, segment_id, conversion_ts FROM pixels),
f AS (SELECT household_id, country, segment_id, min(conversion_ts) AS first_ts FROM once GROUP BY 1, 2, 3),
ranked AS (SELECT p.*, f.first_ts, i.event_ts, i.campaign_id, i.flight_id, i.creative_id,
    row_number() OVER (PARTITION BY p.household_id, p.segment_id, p.country, p.conversion_ts ORDER BY i.event_ts DESC, i.event_id DESC) AS rn
  FROM impressions i JOIN once p ON p.household_id = i.household_id AND p.country = i.country AND i.event_ts <= p.conversion_ts AND date_diff('day', i.event_ts, p.conversion_ts) <= 7
  JOIN f ON f.household_id = p.household_id AND f.country = p.country AND f.segment_id = p.segment_id)
SELECT household_id, country, segment_id, conversion_ts, conversion_ts = first_ts AS is_first, event_ts AS exposure_ts, campaign_id, flight_id, creative_id FROM ranked WHERE rn = 1""",
)
def exposed_visits(t):
    found = px.exposed_visits(t.impressions(), pixel_parts(t)[1], 7)
    return found.select(
        "household_id", "country", "segment_id", "conversion_ts", "is_first", F.col("hit.ts").alias("exposure_ts"),
        *[F.col(f"hit.{c}").alias(c) for c in ("campaign_id", "flight_id", "creative_id")],
    )


def _any_sql(visits: str) -> str:
    return f"""SELECT CAST(p.conversion_ts AS DATE) AS date, p.segment_id, e.creative_name, e.placement AS placement_name, count(DISTINCT e.device_id) AS visitors
FROM exposures e JOIN {visits} p ON p.device_id = e.device_id AND e.event_ts <= p.conversion_ts GROUP BY ALL"""


@query("exposed_visits_any", "exposures pixels", _any_sql("pixels"))
def visits_any(t):
    shown = t.exposures().withColumnRenamed("placement", "placement_name")
    return px.exposed_visits_any(shown, pixel_parts(t)[1])


@query("exposed_first_visits_any", "exposures pixels", _any_sql("(SELECT device_id, segment_id, min(conversion_ts) AS conversion_ts FROM pixels GROUP BY 1, 2)"))
def first_visits_any(t):
    shown = t.exposures().withColumnRenamed("placement", "placement_name")
    return px.exposed_visits_any(shown, pixel_parts(t)[1], first_only=True)


@query(
    "latest_per_key",
    "",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest(t):
    return rows.latest_per_key(t.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "earliest_per_key",
    "",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def earliest(t):
    return rows.latest_per_key(t.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ascending=True).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "campaign_meta",
    "",
    """WITH opp AS (SELECT * FROM (SELECT o_custkey AS order_code, o_orderstatus AS campaign_ref, o_orderkey AS sales_order_id, o_orderpriority AS order_name,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE rn = 1),
so AS (SELECT o_orderkey AS sales_order_id, CAST(o_orderdate AS DATE) AS order_start, CAST(o_orderdate AS DATE) + 90 AS order_end FROM orders WHERE o_orderkey IN (SELECT sales_order_id FROM opp)),
li AS (SELECT * FROM (SELECT l_orderkey AS sales_order_id, l_orderkey * 10 + l_linenumber AS line_id, CAST(l_shipdate AS DATE) + TIME '06:30:00' AS line_start,
    CAST(l_shipdate AS DATE) + 30 + TIME '23:59:59' AS line_end, p.p_brand || ' ' AS product,
    row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate DESC, l_suppkey * 1000000000 + l_partkey DESC) AS rn
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey WHERE l_orderkey IN (SELECT sales_order_id FROM opp)) WHERE rn = 1),
c AS (SELECT DISTINCT s.s_suppkey AS campaign_id, s.s_name AS campaign_name, l.l_returnflag AS rate_type, l.l_tax AS net_unit_cost, l.l_orderkey AS sales_order_id, l.l_orderkey * 10 + l.l_linenumber AS line_id
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_orderkey IN (SELECT sales_order_id FROM opp))
SELECT DISTINCT opp.order_code, opp.campaign_ref, opp.sales_order_id, opp.order_name, so.order_start, so.order_end, c.campaign_id, c.campaign_name, c.rate_type, c.net_unit_cost,
  li.line_id, li.line_start, li.line_end, li.product
FROM opp JOIN so USING (sales_order_id) JOIN c USING (sales_order_id) JOIN li USING (sales_order_id, line_id)""",
)
def campaign_meta(t):
    o, l, s = t.table("orders"), t.table("lineitem"), t.table("supplier")
    opp = o.select(
        F.col("o_custkey").alias("order_code"), F.col("o_orderstatus").alias("campaign_ref"), F.col("o_orderkey").alias("sales_order_id"),
        F.col("o_orderpriority").alias("order_name"), F.col("o_orderdate").alias("modified_ts"), F.col("o_orderkey").alias("version_id"),
    )
    day = F.to_date("o_orderdate")
    sales = o.select(F.col("o_orderkey").alias("sales_order_id"), day.alias("start_date"), F.date_add(day, 90).alias("end_date"), F.col("o_orderdate").alias("modified_ts"), F.col("o_orderkey").alias("version_id"))
    line_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id")
    ship = F.to_date("l_shipdate")
    lines = l.select(
        F.col("l_orderkey").alias("sales_order_id"), line_id, F.col("l_linestatus").alias("name"), ship.alias("start_date"), F.lit("06:30:00").alias("start_time"),
        F.date_add(ship, 30).alias("end_date"), F.lit("23:59:59").alias("end_time"), F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("modified_ts"), (F.col("l_suppkey") * 1_000_000_000 + F.col("l_partkey")).alias("version_id"),
    )
    attrs = l.select(
        F.col("l_suppkey").alias("campaign_id"), F.col("l_orderkey").alias("order_external_id"), F.col("l_orderkey").alias("io_external_id"),
        line_id.alias("line_external_id"), F.col("l_returnflag").alias("rate_type"), F.col("l_tax").alias("net_unit_cost"),
    )
    campaigns = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("start_ts"), F.lit(None).cast("timestamp_ntz").alias("end_ts"))
    products = t.table("part").select(F.col("p_partkey").alias("product_id"), F.concat_ws(" – ", "p_brand", "p_name").alias("product_name"))
    codes = t.market("BUILDING").withColumnRenamed("device_id", "order_code")
    out = mp.campaign_meta(opp, sales, lines, campaigns, attrs, codes, products)
    return out.select(
        "order_code", "campaign_ref", "sales_order_id", "order_name", "order_start", "order_end", "campaign_id", "campaign_name", "rate_type",
        "net_unit_cost", "line_id", "line_start", "line_end", "product",
    ).distinct()


@query("creative_map", "creative_map", "SELECT DISTINCT country, campaign_id, creative_id, creative_name, placement_name FROM creative_map")
def creative_map(t):
    return mp.creative_map(t.creative_map(), ("country", "campaign_id", "creative_id", "creative_name", "placement_name"))


@query(
    "creative_map_refresh",
    "kept order_meta",
    """, sold AS (SELECT * FROM order_meta WHERE advertiser_id IN (1, 2, 3, 5, 8, 13, 21)),
cmpgn AS (SELECT DISTINCT p.p_brand AS campaign_id, p.p_size AS flight_id, p.p_partkey AS creative_id, s.order_code, s.line_item_id
  FROM part p JOIN sold s ON s.advertiser_name = p.p_brand WHERE p.p_brand <> 'Brand#13'),
seen AS (SELECT DISTINCT c.order_code, k.country, k.campaign_id, k.flight_id, k.creative_id FROM kept k JOIN (SELECT DISTINCT order_code, campaign_id, flight_id, creative_id FROM cmpgn) c
    ON c.campaign_id = k.campaign_id AND c.flight_id = k.flight_id AND c.creative_id = k.creative_id
  WHERE k.event_type IN ('impression', 'click', 'tracker') AND k.event_ts BETWEEN TIMESTAMP '2023-10-25 00:00:00' AND TIMESTAMP '2024-01-24 23:59:59'),
lc AS (SELECT DISTINCT line_item_id, campaign_id FROM cmpgn)
SELECT DISTINCT s.advertiser_id, s.advertiser_name, s.country_targeting, k.country, CASE WHEN s.country_targeting = 'USA' THEN 'US' ELSE 'C' || n.n_nationkey END AS mapping_country,
  coalesce(r.r_name, '') AS region, s.order_code, s.sales_order_name AS insertion_order_name, lc.campaign_id, s.order_start AS campaign_start_date, s.order_end AS campaign_end_date,
  k.flight_id, s.line_item_id, s.line_item_name, s.line_item_start AS line_item_start_ts, s.line_item_end AS line_item_end_ts, k.creative_id, p.p_name AS creative_name,
  s.cost_type AS rate_type, s.net_unit_cost AS rate, CASE WHEN s.is_added_value = 1 THEN s.added_value_amount ELSE s.net_cost END AS booked_budget,
  coalesce(s.production_quantity, 0) AS placement_impressions_booked, s.product_name
FROM sold s JOIN lc ON lc.line_item_id = s.line_item_id LEFT JOIN seen k ON k.order_code = s.order_code AND k.campaign_id = lc.campaign_id
LEFT JOIN part p ON p.p_partkey = k.creative_id LEFT JOIN nation n ON n.n_name = s.country_targeting LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE s.line_item_end >= TIMESTAMP '2023-10-25 00:00:00' AND s.line_item_start <= TIMESTAMP '2024-01-24 23:59:59'""",
)
def refresh(t):
    part = t.table("part")
    campaigns = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_brand") == "Brand#13", "archived").otherwise("live").alias("state")).distinct()
    attrs = part.select(F.col("p_brand").alias("campaign_id"), (F.col("p_size") + 1000).alias("order_external_id"), F.col("p_partkey").alias("line_external_id"))
    combos = part.select(F.col("p_brand").alias("campaign_id"), F.col("p_size").alias("flight_id"), F.col("p_partkey").alias("creative_id"))
    nil = F.lit(None).cast("timestamp_ntz")
    flights = part.select(F.col("p_size").alias("id"), F.col("p_brand").alias("campaign_id"), F.lit("f").alias("name"), nil.alias("start_ts"), nil.alias("end_ts")).distinct()
    creatives = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    advertisers = split_param(t.spark, "1, 2,3 ,5,8,13,21", "int", "advertiser_id")
    out = mp.refresh_creative_map(
        t.order_meta(), campaigns, attrs, combos, t.delivery("view", "click", "error"), flights, creatives,
        t.regions(), advertisers, date(2024, 1, 25),
    )
    return out.drop("campaign_name", "flight_name", "flight_start_date", "flight_end_date", "budget_delivered", "last_update_ts").distinct()


@query("enrich_mapping", "enriched", "SELECT mapping_country, order_code, line_item_id, creative_id, is_added_value FROM enriched")
def enrich(t):
    return mp.enrich_mapping(t.mapping(), t.order_meta()).select("mapping_country", "order_code", "line_item_id", "creative_id", "is_added_value")


@query("mapping_freshness", "mapping", "SELECT max(last_update_ts) AS last_update_ts, CAST(date_diff('day', CAST(max(last_update_ts) AS DATE), DATE '2024-01-24') AS INTEGER) AS age_days FROM mapping")
def freshness(t):
    return mp.mapping_age(t.mapping(), date(2024, 1, 24))


@query(
    "session_durations",
    "sessions",
    """SELECT profile_id, start_ts, end_ts, date_diff('second', start_ts, end_ts) AS seconds, date_diff('minute', start_ts, end_ts) AS minutes, date_diff('hour', start_ts, end_ts) AS hours,
  date_diff('day', start_ts, end_ts) AS days, strftime(start_ts, '%Y%m%d%H') AS hour_key FROM sessions WHERE strftime(start_ts, '%Y%m%d%H') BETWEEN '2024010800' AND '2024012123'""",
)
def durations(t):
    s = t.sessions().withColumn("hour_key", dt.hour_key("start_ts"))
    s = s.where(dt.hour_key_range("hour_key", WINDOWS.report_start, WINDOWS.report_end))
    units = {f"{u}s": dt.diff(u, "start_ts", "end_ts").cast("bigint") for u in ("second", "minute", "hour", "day")}
    return s.withColumns(units).select("profile_id", "start_ts", "end_ts", *units, "hour_key")


@query(
    "active_lines",
    "order_meta",
    """SELECT line_item_id, line_item_start, line_item_end, line_item_start < TIMESTAMP '2024-01-21 00:00:00' AND line_item_end >= TIMESTAMP '2024-01-10 00:00:00' AS open_start
FROM order_meta WHERE line_item_start <= TIMESTAMP '2024-01-21 00:00:00' AND line_item_end >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def active_lines(t):
    lo, hi = dt.ts_lit(dt.datetime(2024, 1, 10)), dt.ts_lit(dt.datetime(2024, 1, 21))
    o = t.order_meta().where(p.active_in("line_item_start", "line_item_end", lo, hi, closed=True))
    return o.select("line_item_id", "line_item_start", "line_item_end", p.active_in("line_item_start", "line_item_end", lo, hi).alias("open_start"))


@query(
    "text_cleanup",
    "",
    """SELECT p_partkey, replace(p_brand || ', ' || p_name, ',', '') AS cleaned, split_part(p_brand || ' - ' || p_name, '-', 1) AS product, lower(p_type) AS lowered,
  lpad(CAST(p_size AS VARCHAR), 3, '0') AS padded, CASE WHEN p_size >= 15 THEN '15+' ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS bucket, least(p_size, 20) AS capped,
  string_split(p_name, ' ')[1] AS first_word, array_to_string(list_sort(string_split(p_name, ' ')), '|') AS sorted_words FROM part""",
)
def cleanup(t):
    words = F.split("p_name", " ")
    return t.table("part").select(
        "p_partkey",
        m.strip_commas(F.concat_ws(", ", "p_brand", "p_name")).alias("cleaned"),
        m.product_prefix(F.concat_ws(" – ", "p_brand", "p_name")).alias("product"),
        F.lower("p_type").alias("lowered"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"),
        m.ttc_bucket("p_size").alias("bucket"),
        m.freq_bucket("p_size").alias("capped"),
        F.get(words, F.lit(0)).alias("first_word"),
        F.array_join(F.array_sort(words), "|").alias("sorted_words"),
    )


@query(
    "date_functions",
    "",
    """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, least(CAST(o_orderdate AS DATE), CAST(date_trunc('quarter', o_orderdate) AS DATE) + 10) AS earlier,
  CAST(o_orderdate - INTERVAL 3 MONTH AS DATE) AS three_months_before, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7) + 1 AS INTEGER) AS week_num,
  date_diff('month', CAST(o_orderdate AS DATE), DATE '2002-01-15') AS months_to, make_timestamp(o_orderkey * 100000 * 1000000) AS from_epoch,
  CAST(o_orderdate AS DATE) + TIME '06:30:00' AS opens_at, strftime(o_orderdate, '%Y%m%d') AS day_key FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19960101' AND '19991231'""",
)
def date_functions(t):
    o = t.table("orders").withColumn("day_key", F.date_format("o_orderdate", "yyyyMMdd"))
    o = o.where(dt.day_key_range("day_key", date(1996, 1, 1), date(1999, 12, 31)))
    day = F.to_date("o_orderdate")
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    return o.select(
        "o_orderkey",
        quarter.alias("quarter_start"),
        F.least(day, F.date_add(quarter, 10)).alias("earlier"),
        F.add_months(day, -3).alias("three_months_before"),
        dt.week_number(dt.date_lit(date(1995, 1, 1)), day).alias("week_num"),
        dt.diff("month", day, dt.date_lit(date(2002, 1, 15))).cast("bigint").alias("months_to"),
        dt.epoch_ts(F.col("o_orderkey") * 100_000 + 0.75).alias("from_epoch"),
        dt.ts_of(day, F.lit("06:30:00")).alias("opens_at"),
        "day_key",
    )


@query("id_filter", "", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_custkey AS VARCHAR) IN ('17', '42', '99')")
def id_filter(t):
    return t.table("orders").where(p.id_in("o_custkey", ["17", " 42 ", 99, "", None])).select("o_orderkey", "o_custkey")


@query(
    "guaranteed_row",
    "lines",
    """, none AS (SELECT line_item_id, line_item_name FROM lines WHERE mapping_country = 'NOWHERE')
SELECT DATE '2024-01-24' AS report_execution_date, n.line_item_id, n.line_item_name FROM (SELECT 1) o LEFT JOIN none n ON 1 = 1""",
)
def guaranteed_row(t):
    none = mp.enrich_mapping(t.mapping(), t.order_meta()).where(F.col("mapping_country") == "NOWHERE").select("line_item_id", "line_item_name")
    return rows.ensure_one_row(none, report_execution_date=dt.date_lit(date(2024, 1, 24)))


@query(
    "share_of_country",
    "impressions",
    """, c AS (SELECT country, creative_id, count(*) AS n FROM impressions GROUP BY 1, 2)
SELECT country, creative_id, n, round(n / sum(n) OVER (PARTITION BY country), 6) AS share FROM c""",
)
def share_of_country(t):
    counts = t.impressions().groupBy("country", "creative_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.ratio_to_report(counts, "n", ("country",)).withColumn("share", F.round("share", 6))
