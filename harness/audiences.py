"""Audience queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.operators import audiences as au
from airtally.operators import rows

from .registry import query

EXCLUDED = ("%bolt%", "%blue%", "%GREEN|%")
EXCLUDED_SQL = " OR ".join(f"array_to_string(genres, '|') ILIKE '{x}'" for x in EXCLUDED)


@query("pattern_match", "", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE 'small%'")
def pattern_match(t):
    return rows.match_any_pattern(t.table("part"), "p_name", ["%RING%", "small%"]).select("p_partkey", "p_name")


@query("exclude_patterns", "programs", f"SELECT program_id, array_to_string(list_sort(genres), '|') AS genres FROM programs WHERE NOT ({EXCLUDED_SQL})")
def exclude_patterns(t):
    return au.genre_content(t.programs(), EXCLUDED).select("program_id", "genres")


@query("preferred_titles", "titles", """SELECT program_id, title FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY
  CASE WHEN title_language = 'en' THEN '__en' WHEN title_language LIKE 'en%' THEN '_' || title_language ELSE title_language END, title) AS rn FROM titles) WHERE rn = 1""")
def preferred(t):
    return au.preferred_titles(t.titles()).select("program_id", "title")


@query(
    "content_in_session",
    "content sessions",
    """SELECT c.profile_id, c.content_id, c.content_type, c.start_ts, c.end_ts, s.start_ts AS session_start, s.end_ts AS session_end
FROM content c JOIN sessions s ON s.profile_id = c.profile_id AND c.start_ts >= s.start_ts AND c.end_ts <= s.end_ts""",
)
def content_in_session(t):
    s = t.sessions().select("profile_id", F.col("start_ts").alias("session_start"), F.col("end_ts").alias("session_end"))
    c = t.content().select("profile_id", "content_id", "content_type", "start_ts", "end_ts")
    return rows.contained_in(c, s, ["profile_id"], ("start_ts", "end_ts"), ("session_start", "session_end"), bin_seconds=1800)


@query(
    "content_audience",
    "exposures usage_in content titles programs",
    """, watched AS (SELECT DISTINCT c.profile_id FROM content c JOIN titles t ON CAST(t.program_id AS VARCHAR) = c.content_id JOIN programs p ON p.program_id = t.program_id
  WHERE (t.title ILIKE '%ring%' OR t.title ILIKE 'SMALL%') AND p.season_number = 2 AND c.content_type <> 'OTT_AD')
SELECT DISTINCT u.device_id, u.profile_id FROM exposures e JOIN usage_in u ON u.device_id = e.device_id AND e.event_ts <= u.conversion_ts
WHERE u.profile_id IN (SELECT profile_id FROM watched) AND u.profile_id IN (SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 3 AND 20)""",
)
def content_audience(t):
    content = t.content().where(F.col("content_type") != "OTT_AD")
    watched = au.watched_titles(content, t.titles(), t.programs(), ["%ring%", "SMALL%"], season=2)
    sets = t.table("customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("model_year"))
    return au.content_audience(t.exposures(), t.usage_in(), watched, au.model_years(sets, 3, 20))


BASE = """, fresh AS (SELECT f.* FROM (SELECT device_id, profile_id, min(conversion_ts) AS first_ts FROM seconds_usage WHERE device_id IS NOT NULL GROUP BY 1, 2) f
  WHERE EXISTS (SELECT 1 FROM seconds_usage a WHERE a.device_id = f.device_id AND a.profile_id = f.profile_id AND a.conversion_ts > f.first_ts AND a.seconds >= 30)),
qualified AS (SELECT DISTINCT a.device_id, a.profile_id, a.conversion_ts, a.end_ts, f.first_ts + INTERVAL 30 DAY AS until_ts FROM seconds_usage a
  JOIN fresh f ON f.device_id = a.device_id AND f.profile_id = a.profile_id AND a.conversion_ts >= f.first_ts AND a.seconds >= 30),
base AS (SELECT q.device_id, q.profile_id, q.conversion_ts, c.content_id, q.until_ts, CAST(sum(date_diff('second', c.start_ts, c.end_ts)) AS BIGINT) AS content_seconds
  FROM qualified q JOIN content c ON c.profile_id = q.profile_id AND c.start_ts >= q.conversion_ts AND c.end_ts <= q.end_ts AND c.content_type IN ('PROG', 'VOD', 'OTT_PROG')
  GROUP BY 1, 2, 3, 4, 5 HAVING sum(date_diff('second', c.start_ts, c.end_ts)) >= 30)
"""


def half_minute(t):
    usage = t.usage(min_seconds=60, unit="second", name="seconds")
    return au.qualified_content(usage, t.content(), threshold_seconds=30, days=30)


@query("qualified_content", "seconds_usage content", BASE + "SELECT * FROM base")
def qualified(t):
    return half_minute(t)


@query(
    "new_user_audience",
    "seconds_usage content",
    BASE
    + """SELECT device_id, profile_id, count(*) AS content_sessions FROM (SELECT DISTINCT device_id, profile_id, conversion_ts, content_id FROM base WHERE conversion_ts <= until_ts)
GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def new_user_audience(t):
    return au.new_user_audience(half_minute(t), 2)


@query(
    "only_genre_audience",
    "seconds_usage content programs titles",
    BASE
    + f""", genre AS (SELECT CAST(program_id AS VARCHAR) AS content_id FROM programs WHERE array_to_string(genres, '|') <> '' AND NOT ({EXCLUDED_SQL})),
named AS (SELECT DISTINCT g.content_id FROM genre g JOIN titles t ON CAST(t.program_id AS VARCHAR) = g.content_id),
allc AS (SELECT device_id, profile_id, count(*) AS event_count FROM base GROUP BY 1, 2),
genc AS (SELECT device_id, profile_id, count(*) AS event_count FROM base JOIN named USING (content_id) GROUP BY 1, 2)
SELECT a.device_id, a.profile_id, a.event_count FROM allc a JOIN genc g ON g.device_id = a.device_id AND g.profile_id = a.profile_id AND g.event_count = a.event_count""",
)
def only_genre(t):
    return au.only_genre_audience(half_minute(t), au.genre_content(t.programs(), EXCLUDED), au.preferred_titles(t.titles()))


@query("audience_or", "", "SELECT c_custkey AS device_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def audience_or(t):
    return rows.audience_or(t.market("BUILDING"), _urgent(t))


def _urgent(t):
    return t.table("orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("device_id"))


def _active(t):
    return t.table("events").select(F.col("user_id").alias("device_id"))


@query(
    "audience_and",
    "",
    """SELECT c_custkey AS device_id FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT user_id FROM events""",
)
def audience_and(t):
    return rows.audience_and(t.market("BUILDING"), _urgent(t), _active(t))


@query("set_difference", "", "SELECT c_custkey AS device_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def set_difference(t):
    return rows.exclude(t.market("BUILDING"), _urgent(t), "device_id")
