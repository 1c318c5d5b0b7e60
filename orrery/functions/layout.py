"""Time layouts written by example (``2006-01-02 15:04:05``) as Spark patterns."""

from __future__ import annotations

import re

# The parts of an example layout and the Spark pattern letters for each.
PARTS = {
    "2006": "yyyy",
    "06": "yy",
    "January": "MMMM",
    "Jan": "MMM",
    "01": "MM",
    "1": "M",
    "Monday": "EEEE",
    "Mon": "EEE",
    "02": "dd",
    "2": "d",
    "002": "DDD",
    "15": "HH",
    "03": "hh",
    "3": "h",
    "04": "mm",
    "4": "m",
    "05": "ss",
    "5": "s",
    "PM": "a",
    "MST": "z",
    "-0700": "xx",
    "-07:00": "xxx",
    "Z07:00": "XXX",
}

_PART = re.compile("|".join([*(re.escape(p) for p in sorted(PARTS, key=len, reverse=True)), r"(?<=5)[.,](?:0+|9+)"]))


def spark_pattern(layout: str) -> str:
    """The Spark pattern of a layout; a layout without example parts is taken for a Spark pattern already.

    Letters and digits that belong to no part of an example layout are an error,
    except a ``T`` between date and time.
    """
    if not re.search(r"\d", layout):
        return layout
    out, at = [], 0
    for m in _PART.finditer(layout):
        out.append(_literal(layout[at : m.start()], layout))
        part = m[0]
        out.append(PARTS.get(part) or part[0] + "S" * (len(part) - 1))
        at = m.end()
    return "".join([*out, _literal(layout[at:], layout)])


def _literal(text: str, layout: str) -> str:
    if re.search(r"[A-SU-Za-z0-9]", text):
        raise ValueError(f"time layout {layout!r}: {text!r} is no part of a layout")
    return text.replace("T", "'T'")
