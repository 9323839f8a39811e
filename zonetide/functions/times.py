"""Instants, ages and month windows. ``now`` is always a parameter."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from .fixed import HISTORY_MONTHS_DEFAULT, HISTORY_MONTHS_MAX
from .text import col

Now = datetime | str | None


def utc_now(now: Now = None) -> datetime:
    """The moment a report is made for: given, or the clock; naive values are UTC."""
    if now is None:
        return datetime.now(timezone.utc)
    if isinstance(now, str):
        now = datetime.fromisoformat(now.replace("Z", "+00:00"))
    return now if now.tzinfo else now.replace(tzinfo=timezone.utc)


def parse_utc(value: Column | str) -> Column:
    """Text timestamp with blank or ``T`` and optional zone; UTC when no zone is given."""
    text = col(value).cast("string")
    # a second zone is no timestamp, so the first attempt reads only texts without one
    return F.coalesce(F.concat(text, F.lit("+00:00")).try_cast("timestamp"), text.try_cast("timestamp"))


def age_hours(value: Column | str, now: Now = None) -> Column:
    """Whole hours from a text timestamp to ``now``, halves rounded up; null if unreadable."""
    moment = F.lit(int(utc_now(now).timestamp() * 1000))
    hours = (moment - F.unix_millis(parse_utc(value))) / F.lit(3_600_000.0)
    return F.floor(hours + F.lit(0.5)).cast("bigint")


def month_window_start(now: Now = None, months: int | None = None) -> Column:
    """First month of a history window, with day overflow carried into the next month.

    No month, or 0, means 12; more than 36 means 36; a negative value gives no window.
    """
    back = min(months or HISTORY_MONTHS_DEFAULT, HISTORY_MONTHS_MAX)
    if back < 0:
        return F.lit(None).cast("string")
    today = utc_now(now).astimezone(timezone.utc).date()
    first = F.add_months(F.trunc(F.lit(today), "MM"), -back)
    return F.date_format(F.date_add(first, today.day - 1), "yyyy-MM")


def report_months(now: Now = None, months_back: int = 3) -> list[str]:
    """Report months worth asking for: two months before ``now``, and backwards from it."""
    today = utc_now(now).astimezone(timezone.utc)
    last = today.year * 12 + today.month - 1 - 2
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(last, last - months_back, -1)]


def previous_month(month: Column | str) -> Column:
    """The ``yyyy-MM`` before a ``yyyy-MM``."""
    first = F.concat(col(month), F.lit("-01")).cast("date")
    return F.date_format(F.add_months(first, -1), "yyyy-MM")


def month_of(value: Column | str) -> Column:
    """``yyyy-MM`` of a timestamp, without going through the session zone."""
    return F.substring(col(value).cast("string"), 1, 7)


def day_of(value: Column | str) -> Column:
    return F.substring(col(value).cast("string"), 1, 10)
