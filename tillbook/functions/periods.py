"""Date periods (PER1-PER5). All bounds are computed from ``as_of`` on the driver as literals,
so Catalyst folds them and pushes the range into the parquet scan of the fact table.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import as_datetime, ts_lit


@dataclass(frozen=True)
class Period:
    """Closed interval [start, end]; None on a side means unbounded."""
    start: dt.datetime | None
    end: dt.datetime | None

    def contains(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        conds = []
        if self.start is not None:
            conds.append(c >= ts_lit(self.start))
        if self.end is not None:
            conds.append(c <= ts_lit(self.end))
        if not conds:
            return F.lit(True)
        out = conds[0]
        for extra in conds[1:]:
            out = out & extra
        return out


def _midnight(t: dt.datetime) -> dt.datetime:
    return dt.datetime(t.year, t.month, t.day)


def minus_months(day: dt.date, months: int) -> dt.date:
    """Calendar month step that clamps to the month's end (2001-03-31 minus one month is 2001-02-28)."""
    total = day.year * 12 + (day.month - 1) - months
    year, month = divmod(total, 12)
    month += 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def report_period(name: str, as_of, start=None, end=None) -> Period:
    """PER1, on-screen reports: today / week (7 days back) / month and anything else (30 days back)
    run from midnight to as_of; custom runs from start 00:00:00 to end 23:59:59. Both ends inclusive."""
    now = as_datetime(as_of)
    if name == "today":
        return Period(_midnight(now), now)
    if name == "week":
        return Period(_midnight(now - dt.timedelta(days=7)), now)
    if name == "custom":
        if start is None or end is None:
            raise ValueError("custom period needs start and end")
        return Period(_midnight(as_datetime(start)), _midnight(as_datetime(end)).replace(hour=23, minute=59, second=59))
    return Period(_midnight(now - dt.timedelta(days=30)), now)


def export_range(name: str, as_of, start=None, end=None) -> tuple[dt.date | None, dt.date | None]:
    """PER2 as half-open dates (first day, day after the last); None where the range is open.

    today = same calendar date; week / month / year = on or after today minus one
    calendar week / month / year (no upper bound); custom = date between start and
    end; any other name = everything.
    """
    today = as_datetime(as_of).date()
    if name == "today":
        return today, today + dt.timedelta(days=1)
    if name == "week":
        return today - dt.timedelta(days=7), None
    if name == "month":
        return minus_months(today, 1), None
    if name == "year":
        return minus_months(today, 12), None
    if name == "custom":
        if not start or not end:
            raise ValueError("custom export needs both start and end dates")
        return as_datetime(start).date(), as_datetime(end).date() + dt.timedelta(days=1)
    return None, None


def export_period(name: str, as_of, start=None, end=None) -> Column | None:
    """PER2, exports: a predicate builder over a timestamp column, a function col -> Column. Date tests are
    written as half-open timestamp ranges (``export_range``) so they stay pushable into the scan.
    """
    def build(col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        lo, hi = export_range(name, as_of, start, end)
        test = F.lit(True) if lo is None else c >= ts_lit(lo)
        return test if hi is None else test & (c < ts_lit(hi))

    return build


def preset_period(name: str, as_of) -> Period:
    """PER3, the picker presets; the chosen dates are then sent as a custom PER1 period."""
    today = as_datetime(as_of).date()
    if name == "Today":
        a, b = today, today
    elif name == "Yesterday":
        a = b = today - dt.timedelta(days=1)
    elif name == "Last 7 Days":
        a, b = today - dt.timedelta(days=6), today
    elif name == "Last 30 Days":
        a, b = today - dt.timedelta(days=29), today
    elif name == "This Month":
        a = today.replace(day=1)
        b = today.replace(day=calendar.monthrange(today.year, today.month)[1])
    elif name == "Last Month":
        first = today.replace(day=1)
        b = first - dt.timedelta(days=1)
        a = b.replace(day=1)
    else:
        raise ValueError(f"unknown preset {name!r}")
    return report_period("custom", as_of, a, b)


def _js_minus_month(day: dt.date) -> dt.date:
    """Date.setMonth(month - 1): the day of month is kept and overflows into the next month."""
    year, month = (day.year, day.month - 1) if day.month > 1 else (day.year - 1, 12)
    last = calendar.monthrange(year, month)[1]
    if day.day <= last:
        return dt.date(year, month, day.day)
    return dt.date(year, month, last) + dt.timedelta(days=day.day - last)


def order_period(name: str, as_of, start=None, end=None) -> tuple[dt.date, dt.date] | None:
    """PER4 / PER5, order-list dates (inclusive): today; week = 7 days back; month = one month back
    with the page's day overflow; admin_default = 30 days back; custom = given dates; else no filter."""
    today = as_datetime(as_of).date()
    if name == "today":
        return today, today
    if name == "week":
        return today - dt.timedelta(days=7), today
    if name == "month":
        return _js_minus_month(today), today
    if name == "admin_default":
        return today - dt.timedelta(days=30), today
    if name == "custom":
        if not start or not end:
            raise ValueError("Please select both start and end dates")
        return as_datetime(start).date(), as_datetime(end).date()
    return None


def in_dates(col, dates: tuple[dt.date, dt.date] | None) -> Column:
    """created_at's date between two inclusive dates (no filter for None)."""
    if dates is None:
        return F.lit(True)
    c = F.col(col) if isinstance(col, str) else col
    first, last = as_datetime(dates[0]).date(), as_datetime(dates[1]).date()
    return (c >= ts_lit(first)) & (c < ts_lit(last + dt.timedelta(days=1)))
