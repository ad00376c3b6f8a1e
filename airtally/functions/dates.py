"""Date and time expressions.

Differences count unit *boundaries crossed*, the warehouse meaning of
``DATEDIFF``: 00:00:59 -> 00:01:01 is one minute although only two seconds pass.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: datetime) -> Column:
    """Zone-free timestamp literal; unlike ``F.lit`` it still reaches a parquet scan
    as a pushed filter when the column is ``timestamp_ntz``."""
    return F.expr(f"TIMESTAMP_NTZ '{value:%Y-%m-%d %H:%M:%S.%f}'")


def date_lit(value: date) -> Column:
    return F.expr(f"DATE '{value:%Y-%m-%d}'")


def day(ts) -> Column:
    return F.to_date(_col(ts))


def diff(unit: str, start, end) -> Column:
    """Boundaries of ``unit`` crossed between two timestamps (or dates, for days)."""
    start, end = _col(start), _col(end)
    if unit == "day":
        return F.datediff(end, start)
    if unit == "month":
        return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    n = UNIT_SECONDS[unit]
    if n == 1:
        return F.unix_timestamp(end) - F.unix_timestamp(start)
    floor_of = lambda c: F.floor(F.unix_timestamp(c) / n)
    return floor_of(end) - floor_of(start)


def hour_key(ts) -> Column:
    """``yyyyMMddHH`` partition key of a timestamp."""
    return F.date_format(_col(ts), "yyyyMMddHH")


def hour_key_range(column, start: datetime, end: datetime) -> Column:
    """Range predicate on a ``yyyyMMddHH`` string partition column (prunes partitions)."""
    return _col(column).between(f"{start:%Y%m%d%H}", f"{end:%Y%m%d%H}")


def day_key_range(column, start: date, end: date) -> Column:
    return _col(column).between(f"{start:%Y%m%d}", f"{end:%Y%m%d}")


def hour_key_to_ts(key) -> Column:
    return F.to_timestamp_ntz(_col(key), F.lit("yyyyMMddHH"))


def between_ts(ts, start: datetime, end: datetime) -> Column:
    """Closed range on the raw column, so that it is pushed down."""
    ts = _col(ts)
    return (ts >= ts_lit(start)) & (ts <= ts_lit(end))


def between_days(ts, start: date, end: date) -> Column:
    """Whole days ``start``..``end`` as a half-open range on the raw column."""
    ts = _col(ts)
    midnight = datetime(start.year, start.month, start.day)
    last = datetime(end.year, end.month, end.day)
    return (ts >= ts_lit(midnight)) & (ts < ts_lit(last) + F.expr("INTERVAL 1 DAY"))


def epoch_ts(seconds) -> Column:
    """Fractional epoch seconds to a zone-free timestamp, fraction dropped."""
    whole = F.floor(_col(seconds)).cast("bigint")
    return F.timestamp_add("SECOND", whole, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def ts_of(day_col, time_col) -> Column:
    """Date plus an ``HH:mm:ss`` time of day."""
    text = F.concat_ws(" ", _col(day_col).cast("string"), _col(time_col))
    return F.when(_col(day_col).isNotNull() & _col(time_col).isNotNull(), F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def week_number(first_day, d) -> Column:
    """1 for the seven days starting at ``first_day``, 2 for the next seven, ..."""
    return (F.floor(F.datediff(_col(d), _col(first_day)) / 7) + 1).cast("int")


def label_to_date(label, year: int) -> Column:
    """``minutes_22_apr`` / ``MINUTES_1_MAY`` -> date in ``year``."""
    parts = F.split(F.lower(_col(label)), "_")
    text = F.concat_ws("_", F.lit(str(year)), F.get(parts, F.lit(1)), F.initcap(F.get(parts, F.lit(2))))
    return F.to_date(text, "yyyy_d_MMM")


def label_date(label: str, year: int) -> date:
    """The same for one column name, on the driver."""
    _, day_of_month, month = label.lower().split("_")
    return datetime.strptime(f"{year} {int(day_of_month)} {month[:3]}", "%Y %d %b").date()


def quarter_or_earlier(as_of: date, start: date) -> date:
    """Earlier of a start date and the first day of ``as_of``'s quarter."""
    quarter = date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1)
    return min(quarter, start)
