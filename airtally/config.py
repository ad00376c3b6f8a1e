"""Report parameters. Everything here runs on the driver and yields literals."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta


def add_months(d, n: int):
    """Calendar month shift; the day is clamped to the target month's end."""
    month = d.month - 1 + n
    year, month = d.year + month // 12, month % 12 + 1
    return d.replace(year=year, month=month, day=min(d.day, calendar.monthrange(year, month)[1]))


def day_start(d: date) -> datetime:
    return datetime.combine(d, time(0, 0, 0))


def day_end(d: date) -> datetime:
    return datetime.combine(d, time(23, 59, 59))


@dataclass(frozen=True)
class Windows:
    report_start: datetime
    report_end: datetime
    lookback_start: datetime
    pixel_start: datetime
    attribution_end: datetime


@dataclass(frozen=True)
class ReportConfig:
    """Named arguments of a report; blank ones get the defaults below.

    ``as_of`` stands in for "today" so that a run can be repeated.
    """

    as_of: date
    start: date | None = None
    end: date | None = None
    attribution_days: int = 7
    lookback_months: int = 12
    pixel_lookback_days: int = 30
    countries: tuple[str, ...] = ()
    app_name: str | None = None
    signup_segment: str = ""
    homepage_segment: str = ""
    min_session_seconds: int = 60
    session_inclusive: bool = True
    attribution_extends: bool = False
    line_fanout: bool = False
    max_rows: int = 999_999
    partner: str = ""
    interval: str = "weekly"
    receipts: str = "N"

    def windows(self) -> Windows:
        start, end = self.start, self.end
        if start is None or end is None:
            start, end = self.as_of - timedelta(days=30), self.as_of
        report_start, report_end = day_start(start), day_end(end)
        return Windows(
            report_start=report_start,
            report_end=report_end,
            lookback_start=add_months(report_start, -abs(self.lookback_months)),
            pixel_start=report_start - timedelta(days=abs(self.pixel_lookback_days)),
            attribution_end=report_end + timedelta(days=abs(self.attribution_days)),
        )


def weekly_window(today: date) -> tuple[date, date]:
    """Monday..Sunday of the last week whose Sunday has come (today counts)."""
    sunday = today - timedelta(days=(today.weekday() + 1) % 7)
    return sunday - timedelta(days=6), sunday


def monthly_window(today: date) -> tuple[date, date]:
    """First of last month .. the 14th of this month (the run falls on the 15th)."""
    first = today.replace(day=1)
    return add_months(first, -1), first + timedelta(days=13)


def blackout_window(start: date, months: int = 6) -> tuple[datetime, datetime]:
    """Closed window before the campaign in which a device must not have used the app."""
    end = day_start(start) - timedelta(seconds=1)
    return add_months(end, -months), end


def required_window(start: date, end: date, attribution_days: int) -> tuple[datetime, datetime]:
    """Closed window in which a conversion counts."""
    return day_start(start), day_end(end) + timedelta(days=attribution_days)
