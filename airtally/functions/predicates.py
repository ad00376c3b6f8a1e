"""Boolean expressions used to select rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import _col, diff


def not_dropped(column="dropped") -> Column:
    """True unless the event is marked dropped; a missing mark counts as kept."""
    return F.coalesce(_col(column), F.lit(False)) == F.lit(False)


def min_duration(start, end, seconds: int, inclusive: bool = True) -> Column:
    lasted = diff("second", start, end)
    return lasted >= seconds if inclusive else lasted > seconds


def active_in(start, end, window_start, window_end, closed: bool = False) -> Column:
    """Line active within a window. ``closed`` also admits a line starting at its end."""
    begins = _col(start) <= window_end if closed else _col(start) < window_end
    return begins & (_col(end) >= window_start)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def like_any(column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    c = _col(column)
    return any_of(c.ilike(p) if ignore_case else c.like(p) for p in patterns)


def exclude_patterns(column, patterns: Iterable[str]) -> Column:
    """No pattern matches, whatever the case; a null text matches none."""
    return ~F.coalesce(like_any(column, patterns, ignore_case=True), F.lit(False))


def id_in(column, values: Iterable) -> Column:
    """Membership with ids compared as text; blanks are ignored, so an empty list keeps nothing."""
    wanted = [str(v).strip() for v in values if v is not None and str(v).strip()]
    return _col(column).cast("string").isin(wanted) if wanted else F.lit(False)


def same_text(a, b) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))


def is_make_good(name, any_spelling: bool = False) -> Column:
    """``_`` matches exactly one character: "make_good" and "make good", not "makegood",
    unless ``any_spelling``."""
    lowered = F.lower(_col(name))
    hit = lowered.like("%make_good%")
    return hit | lowered.like("%makegood%") if any_spelling else hit
