"""The bindings of ``tables.py`` as SQL views, composed into a WITH clause."""

from __future__ import annotations

WINDOW = "BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'"

# name -> (views it needs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "devices": (
        (),
        "SELECT c_custkey AS device_id, n_name AS country, c_mktsegment, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "ev": (
        ("devices",),
        "SELECT e.event_id, e.ts, e.event_type, e.value, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k, d.device_id, d.country FROM events e JOIN devices d ON d.device_id = e.user_id",
    ),
    "delivery": (
        ("ev",),
        """SELECT e.event_id, e.device_id, e.device_id // 3 AS household_id, e.country, e.ts AS event_ts,
  CASE e.event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'error' THEN 'tracker' WHEN 'signup' THEN 'segment' END AS event_type,
  e.k AS creative_id,
  CASE WHEN e.event_type = 'signup' THEN CAST(e.k % 2 AS VARCHAR) END AS segment_id,
  CASE WHEN e.event_type = 'error' THEN CASE e.k % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'first_quartile' WHEN 2 THEN 'midpoint' WHEN 3 THEN 'third_quartile' ELSE 'complete' END END AS tracker,
  CASE WHEN e.value >= 150 THEN TRUE WHEN e.value >= 75 THEN FALSE END AS dropped,
  e.k % 7 AS exchange_id, e.k % 10 + 80 AS exchange_seller_id,
  p.p_name AS creative_name, p.p_brand AS campaign_id, p.p_size AS flight_id, p.p_type AS placement
FROM ev e JOIN part p ON p.p_partkey = e.k WHERE e.event_type IN ('view', 'click', 'error', 'signup')""",
    ),
    "kept": (("delivery",), "SELECT * FROM delivery WHERE dropped IS NULL OR NOT dropped"),
    "impressions": (("kept",), f"SELECT * FROM kept WHERE event_type = 'impression' AND event_ts {WINDOW}"),
    "clicks": (("kept",), f"SELECT * FROM kept WHERE event_type = 'click' AND event_ts {WINDOW}"),
    "tracker": (("kept",), f"SELECT * FROM kept WHERE event_type = 'tracker' AND event_ts {WINDOW}"),
    "exposures": (("kept",), f"SELECT * FROM kept WHERE event_type IN ('impression', 'click') AND event_ts {WINDOW}"),
    "sessions": (
        ("ev",),
        "SELECT device_id AS profile_id, k AS app_id, country, ts AS start_ts, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS end_ts FROM ev WHERE event_type = 'purchase'",
    ),
    "profile_map": ((), "SELECT c_custkey AS profile_id, c_custkey AS device_id FROM customer WHERE c_mktsegment <> 'FURNITURE'"),
    "usage": (
        ("sessions", "profile_map"),
        """SELECT m.device_id, s.profile_id, s.country, s.start_ts AS conversion_ts, max(s.end_ts) AS end_ts,
  CAST(sum(date_diff('minute', s.start_ts, s.end_ts)) AS BIGINT) AS minutes
FROM sessions s LEFT JOIN profile_map m ON m.profile_id = s.profile_id
WHERE date_diff('second', s.start_ts, s.end_ts) >= 3600
  AND s.start_ts BETWEEN TIMESTAMP '2023-01-08 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'
GROUP BY 1, 2, 3, 4""",
    ),
    "usage_in": (("usage",), f"SELECT * FROM usage WHERE conversion_ts {WINDOW}"),
    "hours_usage": (
        ("sessions", "profile_map"),
        """SELECT m.device_id, s.profile_id, s.country, s.start_ts AS conversion_ts,
  CAST(sum(date_diff('hour', s.start_ts, s.end_ts)) AS BIGINT) AS hours
FROM sessions s LEFT JOIN profile_map m ON m.profile_id = s.profile_id
WHERE date_diff('second', s.start_ts, s.end_ts) > 60
  AND s.start_ts BETWEEN TIMESTAMP '2023-01-08 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'
GROUP BY 1, 2, 3, 4""",
    ),
    "seconds_usage": (
        ("sessions", "profile_map"),
        """SELECT m.device_id, s.profile_id, s.country, s.start_ts AS conversion_ts, max(s.end_ts) AS end_ts,
  CAST(sum(date_diff('second', s.start_ts, s.end_ts)) AS BIGINT) AS seconds
FROM sessions s LEFT JOIN profile_map m ON m.profile_id = s.profile_id
WHERE date_diff('second', s.start_ts, s.end_ts) >= 60
  AND s.start_ts BETWEEN TIMESTAMP '2023-01-08 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'
GROUP BY 1, 2, 3, 4""",
    ),
    "content": (
        ("ev",),
        """SELECT device_id AS profile_id, CAST(k AS VARCHAR) AS content_id,
  CASE event_type WHEN 'view' THEN 'PROG' WHEN 'click' THEN 'VOD' WHEN 'error' THEN 'OTT_PROG' WHEN 'signup' THEN 'OTT_AD' END AS content_type,
  ts AS start_ts, ts + to_microseconds(CAST(round(value / 60 * 60000000) AS BIGINT)) AS end_ts, country
FROM ev WHERE event_type <> 'purchase'""",
    ),
    "programs": (
        (),
        "SELECT p_partkey AS program_id, p_size % 5 AS season_number, p_type AS program_type, string_split(p_name, ' ') AS genres FROM part",
    ),
    "titles": (
        (),
        """SELECT p_partkey AS program_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'en-GB' END AS title_language FROM part
UNION ALL SELECT p_partkey, p_brand || ' ' || p_name, CASE WHEN p_size % 3 = 0 THEN 'en' ELSE 'fr' END FROM part""",
    ),
    "universe": (
        ("kept", "sessions", "profile_map"),
        f"""SELECT m.device_id FROM (SELECT c_custkey AS profile_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) h JOIN profile_map m USING (profile_id)
UNION SELECT device_id FROM kept WHERE event_type = 'impression' AND event_ts {WINDOW} AND (exchange_id = 6 OR exchange_seller_id = 86)
UNION SELECT m.device_id FROM sessions s JOIN profile_map m ON m.profile_id = s.profile_id WHERE s.start_ts {WINDOW}""",
    ),
    "mini": (
        ("universe", "usage"),
        """SELECT device_id FROM universe WHERE device_id NOT IN (
  SELECT device_id FROM usage WHERE device_id IS NOT NULL AND conversion_ts BETWEEN TIMESTAMP '2023-07-07 23:59:59' AND TIMESTAMP '2024-01-07 23:59:59')""",
    ),
    "order_meta": (
        (),
        """SELECT CAST(substr(p_brand, 7, 2) AS INTEGER) AS advertiser_id, p_brand AS advertiser_name, p_size AS order_code, p_size + 1000 AS sales_order_id,
  'Order, ' || p_size AS sales_order_name, DATE '2024-01-01' AS order_start, DATE '2024-03-31' AS order_end, p_partkey AS line_item_id,
  p_type || CASE WHEN p_size % 13 = 0 THEN ' make_good' ELSE ', standard' END AS line_item_name,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size % 25) AS line_item_start, TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size % 25 + 20) AS line_item_end,
  CASE p_size % 3 WHEN 0 THEN 'CPM' WHEN 1 THEN 'Flat Rate' ELSE 'Other' END AS cost_type, p_retailprice AS net_unit_cost, p_retailprice * 10 AS net_cost,
  CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS is_added_value, p_retailprice AS added_value_amount,
  CASE WHEN p_size % 4 <> 0 THEN p_size * 100 END AS production_quantity, p_type AS product_name,
  CASE WHEN p_size % 25 = 0 THEN 'USA' ELSE 'NATION_' || (p_size % 25) END AS country_targeting FROM part""",
    ),
    "mapping": (
        ("ev", "order_meta"),
        """SELECT s.country AS mapping_country, o.order_code, o.advertiser_id, o.advertiser_name, o.sales_order_name AS insertion_order_name,
  p.p_brand AS campaign_id, p.p_brand AS campaign_name, o.order_start AS campaign_start_date, o.order_end AS campaign_end_date,
  p.p_size AS flight_id, 'Flight ' || p.p_size AS flight_name, o.line_item_start AS flight_start_date, o.line_item_end AS flight_end_date,
  o.line_item_id, o.line_item_name, s.creative_id, p.p_name AS creative_name, o.cost_type AS rate_type, o.net_unit_cost AS rate,
  CASE WHEN o.is_added_value = 1 THEN o.added_value_amount ELSE o.net_cost END AS booked_budget,
  coalesce(o.production_quantity, 0) AS placement_impressions_booked, o.product_name,
  o.line_item_start AS line_item_start_ts, o.line_item_end AS line_item_end_ts, o.line_item_start AS last_update_ts
FROM (SELECT DISTINCT country, k AS creative_id FROM ev WHERE event_type IN ('view', 'click')) s
JOIN part p ON p.p_partkey = s.creative_id JOIN order_meta o ON o.line_item_id = s.creative_id""",
    ),
    "enriched": (
        ("mapping", "order_meta"),
        "SELECT m.*, o.is_added_value FROM mapping m LEFT JOIN order_meta o ON o.order_code = m.order_code AND o.line_item_id = m.line_item_id",
    ),
    "lines": (
        ("enriched",),
        "SELECT DISTINCT * FROM enriched WHERE line_item_start_ts < TIMESTAMP '2024-01-21 23:59:59' AND line_item_end_ts >= TIMESTAMP '2024-01-08 00:00:00'",
    ),
    "creative_map": (
        ("ev",),
        """SELECT s.country, p.p_brand AS campaign_id, s.creative_id, p.p_name AS creative_name, p.p_type AS placement_name
FROM (SELECT DISTINCT country, k AS creative_id FROM ev WHERE event_type IN ('view', 'click')) s JOIN part p ON p.p_partkey = s.creative_id""",
    ),
    "households": (
        ("kept", "profile_map"),
        """SELECT household_id, device_id, profile_id FROM (
  SELECT k.household_id, m.device_id, m.profile_id, row_number() OVER (PARTITION BY k.household_id ORDER BY k.event_ts DESC, k.event_id DESC) AS rn
  FROM kept k JOIN profile_map m ON m.device_id = k.device_id
  WHERE k.event_type IN ('impression', 'click') AND k.event_ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59') WHERE rn = 1""",
    ),
    "pixels": (
        ("kept", "households"),
        """SELECT k.household_id, k.country, k.segment_id, k.event_ts AS conversion_ts, h.device_id FROM kept k JOIN households h ON h.household_id = k.household_id
WHERE k.event_type = 'segment' AND k.segment_id IN ('0', '1') AND k.event_ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'""",
    ),
    "long_log": (
        (),
        """SELECT t.name, t.role, t.region, CASE WHEN t.team = '0' THEN '' ELSE t.team END AS team, trim(t.department) AS department, t.category, t.task, t.sales_cycle,
  t.log_date, t.minutes_active, CAST(floor(date_diff('day', min(t.log_date) OVER (), t.log_date) / 7) + 1 AS INTEGER) AS week_num
FROM (
  SELECT s.s_name AS name, 'Role ' || (s.s_suppkey % 4) AS role, r.r_name AS region, CASE WHEN n.n_nationkey % 3 = 0 THEN '0' ELSE n.n_name END AS team,
    ' ' || r.r_name || ' ' AS department, l.l_returnflag AS category, 'Task ' || l.l_linenumber AS task, l.l_linestatus AS sales_cycle,
    v.log_date, v.hours * 60 AS minutes_active
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey,
    LATERAL (SELECT DATE '2024-04-22' AS log_date, l.l_quantity AS hours UNION ALL SELECT DATE '2024-05-01', l.l_discount UNION ALL SELECT DATE '2024-05-14', l.l_tax) v
  WHERE l.l_discount > 0 AND v.hours * 60 > 0) t""",
    ),
    "task_map": (
        (),
        """SELECT DISTINCT r.r_name AS department, CASE l.l_linenumber % 3 WHEN 0 THEN 'Pre Sales' WHEN 1 THEN 'Post Sales' ELSE 'Pre and Post Sales' END AS sales_cycle,
  l.l_returnflag AS category, CASE l.l_linenumber WHEN 2 THEN 'PTO' WHEN 5 THEN 'Meetings' ELSE '' END AS change_category, 'Task ' || l.l_linenumber AS task
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE l.l_linenumber <> r.r_regionkey + 1""",
    ),
    "sheet_report": (
        ("long_log", "task_map"),
        """SELECT t.name, t.role, t.region, t.team, t.department, CASE WHEN coalesce(m.change_category, '') <> '' THEN m.change_category ELSE t.category END AS category,
  t.task, m.sales_cycle, t.log_date, t.minutes_active, t.week_num,
  CASE t.role WHEN 'Role 0' THEN 'Lead' WHEN 'Role 3' THEN NULL ELSE 'Member' END AS leadership_status,
  CASE WHEN r.r_regionkey < 3 THEN 'Client Facing' ELSE 'Internal' END AS client_facing_status
FROM long_log t LEFT JOIN task_map m ON m.department = t.department AND m.task = t.task AND m.category = t.category
LEFT JOIN region r ON r.r_name = t.department""",
    ),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` (a SELECT, or ``, more AS (...) SELECT``) after the views it needs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = body.strip()
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n" + body
