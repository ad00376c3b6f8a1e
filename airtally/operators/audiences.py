"""Audience segments from usage and watched content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import diff
from ..functions.metrics import language_rank
from ..functions.predicates import exclude_patterns
from .rows import contained_in, match_any_pattern, semi

# Genre patterns that rule a programme out of the sports genre.
NOT_SPORTS = (
    "Action", "%Action|%", "Art", "%Art|%", "%Affairs%", "%Adventure%", "%Aviation%", "%Agriculture%",
    "%Animated%", "%Anime%", "%Animal%", "%Anthology%", "%Auction%", "Auto", "%Award%", "%Biography%",
    "%Children%", "%Collect%", "%Comedy%", "%Computer%", "Community", "%Consumer%", "%Cook%", "%Craft%",
    "%Crime%", "%Drama%", "%Documentary%", "%Education%", "%Entertain%", "%Erotic%", "%Exercise%",
    "%Fantasy%", "%Fashion%", "%Finan%", "%Fiction%", "%fundraiser%", "%Garden%", "%Gay%", "%Health%",
    "%History%", "%Hobbies%", "%Holiday%", "%Home%", "%Horror%", "%How%", "%Interview%", "%Improvement%",
    "%Law%", "%Medic%", "%Mystery%", "%Nature%", "%News%", "%Music%", "%Paranormal%", "%Performing%",
    "%Politic%", "%Reality%", "%Religi%", "%Romance%", "%Soap%", "%Science%", "%Sitcom%", "%Shop%",
    "%Special%", "%Suspense%", "%Talk%", "%Technolog%", "%Travel%", "%Thriller%", "%Variety%", "%War%",
    "%Weather%", "%Western%",
)

# Content types that are programmes (linear, film, streamed show).
PROGRAMME_TYPES = ("PROG", "VOD", "OTT_PROG")

USER = ("device_id", "profile_id")


def watched_titles(content: DataFrame, titles: DataFrame, programs: DataFrame, patterns: Sequence[str], season: int | None = None) -> DataFrame:
    """Content whose title matches a pattern (and season, if one is required).

    Titles are cut down by the patterns before they meet the content log.
    """
    wanted = match_any_pattern(titles, "title", patterns).join(programs, "program_id")
    if season is not None:
        wanted = wanted.where(F.col("season_number") == season)
    keyed = wanted.withColumn("content_id", F.col("program_id").cast("string"))
    return content.join(keyed, "content_id").select("profile_id", "content_type", "program_id", "title", "season_number").distinct()


def content_audience(exposures: DataFrame, usage: DataFrame, watched: DataFrame, tv_profiles: DataFrame) -> DataFrame:
    """Devices that used the app after an exposure, on a profile that watched the
    content and whose set is of a wanted model year.

    "After some exposure" only needs the first exposure and the last use.
    """
    shown = exposures.groupBy("device_id").agg(F.min("event_ts").alias("_shown"))
    used = usage.where(F.col("device_id").isNotNull()).groupBy(*USER).agg(F.max("conversion_ts").alias("_used"))
    exposed = used.join(shown, "device_id").where(F.col("_shown") <= F.col("_used")).select(*USER)
    return semi(semi(exposed, watched, ["profile_id"]), tv_profiles, ["profile_id"])


def model_years(profiles: DataFrame, first: int, last: int, country: str | None = None) -> DataFrame:
    kept = profiles.where(F.col("model_year").between(first, last))
    if country is not None:
        kept = kept.where(F.col("country") == country)
    return kept.select("profile_id", "model_year").distinct()


def new_users(usage: DataFrame, threshold_seconds: int = 360, days: int = 30) -> DataFrame:
    """First use of users who come back later for at least ``threshold_seconds``."""
    long_enough = F.when(F.col("seconds") >= threshold_seconds, F.col("conversion_ts"))
    firsts = usage.groupBy(*USER).agg(F.min("conversion_ts").alias("first_ts"), F.max(long_enough).alias("_last_long"))
    return firsts.where(F.col("_last_long") > F.col("first_ts")).select(
        *USER, "first_ts", F.expr(f"first_ts + INTERVAL {int(days)} DAY").alias("until_ts")
    )


def qualified_content(
    usage: DataFrame,
    content: DataFrame,
    threshold_seconds: int = 360,
    days: int = 30,
    types: Sequence[str] = PROGRAMME_TYPES,
    bin_seconds: int = 3600,
) -> DataFrame:
    """Content sessions of new users: time per title within one app session, when the
    session and the title both last at least ``threshold_seconds``."""
    fresh = new_users(usage, threshold_seconds, days)
    long_sessions = usage.where(F.col("seconds") >= threshold_seconds).select(*USER, "conversion_ts", "end_ts").distinct()
    sessions = long_sessions.where(F.col("device_id").isNotNull()).join(fresh, list(USER))
    shows = content.where(F.col("content_type").isin(*types)).select("profile_id", "content_id", "start_ts", F.col("end_ts").alias("stop_ts"))
    inside = contained_in(shows, sessions, ["profile_id"], ("start_ts", "stop_ts"), ("conversion_ts", "end_ts"), bin_seconds)
    watched = inside.groupBy(*USER, "conversion_ts", "content_id", "until_ts").agg(
        F.sum(diff("second", "start_ts", "stop_ts")).alias("content_seconds")
    )
    return watched.where(F.col("content_seconds") >= threshold_seconds)


def new_user_audience(base: DataFrame, min_sessions: int = 2) -> DataFrame:
    """Users with several content sessions (session x title) soon after their first use."""
    counted = base.where(F.col("conversion_ts") <= F.col("until_ts")).groupBy(*USER).agg(
        F.countDistinct("conversion_ts", "content_id").alias("content_sessions")
    )
    return counted.where(F.col("content_sessions") >= min_sessions)


def genre_content(programs: DataFrame, excluded: Sequence[str] = NOT_SPORTS) -> DataFrame:
    """Programmes with genres, none of which matches an excluded pattern."""
    listed = F.array_join("genres", "|")
    kept = programs.where((listed != "") & exclude_patterns(listed, excluded))
    return kept.select(
        "program_id",
        F.col("program_id").cast("string").alias("content_id"),
        "program_type",
        F.array_join(F.array_sort("genres"), "|").alias("genres"),
    ).distinct()


def preferred_titles(titles: DataFrame, tiebreak: Sequence[str] = ("title",)) -> DataFrame:
    """One main title per programme, English if there is one."""
    main = titles.where(F.col("title_type") == "main").withColumn("_rank", language_rank("title_language"))
    by = W.partitionBy("program_id").orderBy(F.col("_rank").asc_nulls_last(), *tiebreak)
    best = main.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") == 1)
    return best.select("program_id", F.col("program_id").cast("string").alias("content_id"), "title")


def only_genre_audience(base: DataFrame, genres: DataFrame, titles: DataFrame) -> DataFrame:
    """Users all of whose content sessions belong to the genre."""
    wanted = semi(genres.select("content_id"), titles.select("content_id"), ["content_id"]).distinct()
    flagged = base.join(wanted.withColumn("_in", F.lit(1)), "content_id", "left")
    counts = flagged.groupBy(*USER).agg(F.count(F.lit(1)).alias("event_count"), F.count("_in").alias("_genre"))
    return counts.where(F.col("event_count") == F.col("_genre")).drop("_genre")
