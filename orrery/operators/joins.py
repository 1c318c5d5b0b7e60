"""Joins on equal keys, null equal to null by default, with a defined result layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from .relational import require, require_unique

HOW = ("inner", "left", "right", "full", "semi", "anti", "cross")


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | None = None,
    how: str = "inner",
    left_on: str | list[str] | None = None,
    right_on: str | list[str] | None = None,
    suffix: str = "_right",
    null_equal: bool = True,
) -> DataFrame:
    """Left columns, then right columns that aren't keys; a name taken already gets the suffix.

    Right and full joins take a key from the side that has it. Semi and anti
    joins have the left columns only. Spark plans the null-safe equalities as
    keys of a hash or sort-merge join, splits skewed ones at run time and
    broadcasts a side only if its statistics are below its own limit.
    """
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}; there are {', '.join(HOW)}")
    names = lambda x: [x] if isinstance(x, str) else list(x or [])
    lk, rk = names(left_on or on), names(right_on or on)
    require(left, lk)
    require(right, rk)
    if how == "cross":
        lk = rk = []
    elif not lk or len(lk) != len(rk):
        raise ValueError("a join needs as many left keys as right ones, at least one")
    inner = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[col(c).alias(n) for c, n in inner.items()])
    if how == "cross":
        out = left.crossJoin(r)
    else:
        same = (lambda a, b: a.eqNullSafe(b)) if null_equal else (lambda a, b: a == b)
        cond = reduce(lambda a, b: a & b, [same(left[f"`{a}`"], r[inner[b]]) for a, b in zip(lk, rk, strict=True)])
        out = left.join(r, cond, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return out
    key = dict(zip(lk, rk, strict=True))
    keep = [F.coalesce(col(c), F.col(inner[key[c]])).alias(c) if c in key and how in ("right", "full") else col(c) for c in left.columns]
    taken = set(left.columns)
    extra = []
    for c in right.columns:
        if c not in rk:
            extra.append(F.col(inner[c]).alias(c + suffix if c in taken else c))
    out = out.select(*keep, *extra)
    require_unique(out.columns)
    return out


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An inner or left join whose left rows of one key are dealt out over ``salts`` tasks; right rows are repeated for each.

    A row's salt is a hash of the row, the same whenever its task is run again.
    For keys known to be hot where adaptive execution is off; otherwise leave it to Spark's skew handling.
    Spark estimates the repeated rows by the size of the single ones and would broadcast them, so a sort-merge join is asked for.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can salt the left side")
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*[col(c) for c in left.columns]), F.lit(salts)).cast("int"))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r.hint("merge"), [*on, "__salt"], how).drop("__salt")
