"""Date expressions. Naive times are UTC, so sessions run with the UTC zone (see ``session.configure``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATED = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def parse_date(c: Column) -> Column:
    """Timestamp from ``yyyy-MM-dd``, with time after a space or ``T``, with offset or ``Z``; else null."""
    return F.when(c.rlike(_DATED), c.try_cast("timestamp"))


def parse_day(c: Column) -> Column:
    """Date from ``yyyy-MM-dd`` alone; anything longer is no day."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), c.try_cast("date"))


def parse_date_or(c: Column, as_of: Column) -> Column:
    """The search path never drops an unreadable date: it counts as ``as_of``."""
    return F.coalesce(parse_date(c), as_of)


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def lookback_days(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).startswith("week"), value * 7).otherwise(value)


def cutoff(as_of: Column, days: Column, whole_days: bool = True) -> Column:
    """Start of the look-back: from midnight of ``as_of`` for scans, from ``as_of`` itself for searches."""
    start = F.date_trunc("day", as_of) if whole_days else as_of
    return start - F.make_dt_interval(days)


def as_timestamp(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")
