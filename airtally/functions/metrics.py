"""Report measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import _col
from .predicates import is_make_good

# Tracker names that report how far a video played.
VIDEO_TILES = {
    "video_start": ("autoplay_start", "start"),
    "video_25": ("autoplay_first_quartile", "first_quartile"),
    "video_50": ("autoplay_midpoint_quartile", "midpoint"),
    "video_75": ("autoplay_third_quartile", "third_quartile"),
    "video_completions": ("autoplay_complete", "complete"),
}


def ttc_bucket(days, top: int = 15) -> Column:
    """Days to convert as ``00`` .. ``14`` and ``15+``."""
    d = _col(days)
    return F.when(d >= top, F.lit(f"{top}+")).otherwise(F.lpad(d.cast("string"), 2, "0"))


def freq_bucket(count, cap: int = 20) -> Column:
    return F.least(_col(count), F.lit(cap))


def ratio(numerator, denominator) -> Column:
    """Floating division, null when the denominator is 0 or null."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def ctr(clicks, impressions) -> Column:
    return F.coalesce(ratio(clicks, impressions), F.lit(0.0))


def cpc(cost, clicks) -> Column:
    """Cost per click: 0 without clicks, null when the cost is unknown."""
    return F.when(_col(clicks) == 0, F.lit(0.0)).otherwise(ratio(cost, clicks))


def frequency(impressions, reach) -> Column:
    return F.when(_col(impressions) == 0, F.lit(0.0)).otherwise(ratio(impressions, reach))


def budget_delivered(line_name, is_added_value, rate_type, impressions, rate, booked, any_spelling: bool = False) -> Column:
    """Cost of a line: the first matching rule wins. Make-goods and added value are
    free, CPM charges per thousand impressions, flat rate charges what was booked."""
    return (
        F.when(is_make_good(line_name, any_spelling), F.lit(0.0))
        .when(_col(is_added_value) == 1, F.lit(0.0))
        .when(_col(rate_type) == "CPM", _col(impressions).cast("double") / 1000 * _col(rate))
        .when(_col(rate_type) == "Flat Rate", _col(booked).cast("double"))
    )


def booked_budget(is_added_value, added_value_amount, net_cost) -> Column:
    return F.when(_col(is_added_value) == 1, _col(added_value_amount)).otherwise(_col(net_cost))


def is_fully_attributed(exposure_day, as_of, window_days: int) -> Column:
    """'Yes' once the attribution window after the exposure day has passed."""
    return F.when(F.datediff(as_of, _col(exposure_day)) <= window_days, "No").otherwise("Yes")


def strip_commas(column) -> Column:
    return F.replace(_col(column), F.lit(","), F.lit(""))


def zero_label_to_blank(column) -> Column:
    """``'0'`` stands for an empty label in the exports."""
    return F.when(_col(column) == "0", "").otherwise(_col(column))


def product_prefix(name) -> Column:
    """Text before the first dash, long or short."""
    return F.split_part(F.regexp_replace(_col(name), "–", "-"), F.lit("-"), F.lit(1))


def language_rank(language) -> Column:
    """Plain English first, then its variants, then other languages alphabetically."""
    c = _col(language)
    return F.when(c == "en", "__en").when(c.like("en%"), F.concat(F.lit("_"), c)).otherwise(c)


def decoded_country(targeting, code) -> Column:
    return F.when(_col(targeting) == "USA", "US").otherwise(_col(code))
