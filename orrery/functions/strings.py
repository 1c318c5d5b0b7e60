"""String functions; offsets count characters, null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import spark_pattern


def contains(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part))


def starts_with(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends_with(c: Column, suffix: str) -> Column:
    return F.endswith(c, F.lit(suffix))


def to_upper(c: Column) -> Column:
    return F.upper(c)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def replace(c: Column, old: str, new: str) -> Column:
    """All occurrences of a literal; an empty one is found nowhere."""
    return F.replace(c, F.lit(old), F.lit(new))


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip(c: Column, chars: str) -> Column:
    """Without any of the characters at both ends."""
    return F.btrim(c, F.lit(chars))


def lengths(c: Column) -> Column:
    return F.length(c).cast("long")


def split(c: Column, sep: str, index: int) -> Column:
    """Part number ``index`` (from 0) between literal separators; null if there is none."""
    return F.get(F.split(c, re.escape(sep), -1), F.lit(index)) if index >= 0 else F.when(c.isNull(), c)


def slice_(c: Column, start: int, length: int) -> Column:
    """``length`` characters from ``start`` (from 0; negative: from the end, at most to the beginning); null from the end on."""
    n = F.length(c)
    at = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    return F.when(at < n, F.substring(c, at + 1, F.lit(max(0, length))))


def pad(c: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Filled up to ``width`` characters on the left, the right or both sides (the smaller half left); never cut."""
    missing = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    if side == "left":
        return F.concat(F.repeat(F.lit(fill), missing), c)
    if side == "right":
        return F.concat(c, F.repeat(F.lit(fill), missing))
    if side == "both":
        left = F.floor(missing / 2).cast("int")
        return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), missing - left))
    return c


def zfill(c: Column, width: int) -> Column:
    return pad(c, width, "left", "0")


def _checked(pattern: str) -> str:
    """Look-around and back-references have no place in the common subset of regular expressions."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern!r}")
    return pattern


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null without a match or such a group."""
    if group < 0 or group > re.compile(_checked(pattern)).groups:
        return F.when(c.isNull(), c)
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(_checked(pattern))).cast("long")


def capitalize(c: Column) -> Column:
    """First character upper, the others lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 2)))


def to_datetime(c: Column, layout: str = "2006-01-02 15:04:05") -> Column:
    """Parsed by a layout; null where it doesn't fit."""
    return F.try_to_timestamp(c, F.lit(spark_pattern(layout))).cast("timestamp_ntz")
