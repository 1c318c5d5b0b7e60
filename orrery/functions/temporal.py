"""Functions of dates and times (UTC); components are int."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import spark_pattern


def year(c: Column) -> Column:
    return F.year(c)


def month(c: Column) -> Column:
    return F.month(c)


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def hour(c: Column) -> Column:
    return F.hour(c)


def minute(c: Column) -> Column:
    return F.minute(c)


def second(c: Column) -> Column:
    return F.second(c)


def nanosecond(c: Column) -> Column:
    """Nanoseconds within the second."""
    return (F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)) * 1000).cast("int")


def time_part(ns: Column, part: str) -> Column:
    """hour, minute, second or nanosecond of a time of day kept as nanoseconds since midnight."""
    # Nanoseconds of a unit, and how many of it the next larger one has.
    size, wrap = {"hour": (3_600_000_000_000, 24), "minute": (60_000_000_000, 60), "second": (1_000_000_000, 60), "nanosecond": (1, 1_000_000_000)}[part]
    return F.pmod(F.floor(ns / size), F.lit(wrap)).cast("int") if size > 1 else F.pmod(ns, F.lit(wrap)).cast("int")


def weekday(c: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(c) - 1


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def day_of_year(c: Column) -> Column:
    return F.dayofyear(c)


def quarter(c: Column) -> Column:
    return F.quarter(c)


def truncate(c: Column, unit: str, to: str = "timestamp_ntz") -> Column:
    """Cut off to 1h, 1d, 1mo or 1y; other units change nothing. ``to`` is the column's own type."""
    name = {"1h": "hour", "1d": "day", "1mo": "month", "1y": "year"}.get(unit)
    return F.date_trunc(name, c).cast(to) if name else c


def strftime(c: Column, layout: str) -> Column:
    return F.date_format(c, spark_pattern(layout))


def offset_by(c: Column, offset: str, overflow: str = "clamp") -> Column:
    """Moved by an amount such as 7d, 2mo, -1y, 3h, 5m, 10s, 1w; other text changes nothing.

    A day that the resulting month lacks is clamped to its last one, or with
    ``overflow="normalize"`` runs over into the next month.
    """
    m = re.fullmatch(r"([+-]?\d+)(ns|us|ms|s|m|h|d|w|mo|y)", offset)
    if not m:
        return c
    n, unit = int(m[1]), m[2]
    if unit in ("mo", "y"):
        months = n * (12 if unit == "y" else 1)
        moved = c + F.make_interval(months=F.lit(months))
        if overflow == "normalize":
            moved += F.make_dt_interval(days=F.dayofmonth(c) - F.dayofmonth(moved))
        return moved
    micros = {"us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
    total = n // 1000 if unit == "ns" else n * micros[unit]
    days, rest = divmod(total, 86400 * 10**6)
    return c + F.make_dt_interval(days=F.lit(days), secs=F.lit(rest / 10**6))


def epoch(c: Column, unit: str = "s") -> Column:
    """Time since 1970 in s, ms, us or ns; other units count as s."""
    t = c.cast("timestamp")
    if unit == "ms":
        return F.unix_millis(t)
    if unit == "us":
        return F.unix_micros(t)
    if unit == "ns":
        return F.unix_micros(t) * 1000
    return F.unix_seconds(t)


def total_seconds(c: Column, micros: bool = False) -> Column:
    """A duration in seconds: of an interval, or of a long of microseconds."""
    return (c / F.lit(1e6)).cast("double") if micros else c.cast("decimal(20,6)").cast("double")
