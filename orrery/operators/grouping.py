"""Grouping and aggregation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions import expr as E
from .ordered import boundaries, bucket_of
from .relational import require, require_unique

#: Aggregates by name; those of the row order take the order key.
BY_NAME: dict[str, Callable[[Column], Column]] = {
    "sum": E.sum_,
    "mean": E.mean,
    "min": E.min_,
    "max": E.max_,
    "count": E.count,
    "std": E.std,
    "var": E.var,
    "median": E.median,
    "n_unique": E.n_unique,
}
NUMERIC = {"sum", "mean", "std", "var", "median"}


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` with the other columns of ``right``, which has a row at most for its values of the keys; null equals null."""
    to = {k: f"__of{k}" for k in keys}
    right = right.select(*[F.col(c).alias(to.get(c, c)) for c in right.columns])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in to.items()], F.lit(True)), how).drop(*to.values())


def quantiles(df: DataFrame, keys: int, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of the numbers ``__v`` by the keys ``__g0`` and on, interpolated linearly; null values don't count.

    Equal values of a group are counted, and dealt into buckets by value, each of
    which knows from the buckets' counts where it begins. Only the buckets that
    hold a wanted place are sorted, so no task sees a whole group. A group
    without values has no row.
    """
    ks = [f"__g{k}" for k in range(keys)]
    df = df.filter("__v is not null")
    bounds = list(dict.fromkeys(boundaries(df, F.col("__v"))))
    kind = df.schema["__v"].dataType
    counts = df.groupBy(*ks, "__v").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__b", bucket_of(F.col("__v"), bounds, kind) if bounds else F.lit(0))
    group = Window.partitionBy(*ks)
    sizes = counts.groupBy(*ks, "__b").agg(F.sum("__n").alias("__n"))
    sizes = sizes.withColumns({"__to": F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(group)})
    place = {q: (F.col("__all") - 1) * F.lit(float(p)) for q, p in wanted.items()}
    ends = {q: (F.floor(x), F.ceil(x)) for q, x in place.items()}
    within = lambda x, a, b: (x >= a) & (x < b)
    holds = reduce(lambda x, y: x | y, [within(x, F.col("__to") - F.col("__n"), F.col("__to")) for pair in ends.values() for x in pair])
    needed = sizes.filter(holds).withColumn("__start", F.col("__to") - F.col("__n")).drop("__n", "__to")
    rows = _beside(counts, needed, [*ks, "__b"], "inner")
    upto = F.col("__start") + F.sum("__n").over(Window.partitionBy(*ks, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__end", upto).withColumn("__begin", F.col("__end") - F.col("__n"))
    picks = {f"{q}{side}": F.max(F.when(within(x, F.col("__begin"), F.col("__end")), F.col("__v"))).cast("double") for q, pair in ends.items() for side, x in zip("lh", pair, strict=True)}
    found = rows.groupBy(*ks).agg(F.max("__all").alias("__all"), *[c.alias(n) for n, c in picks.items()])
    out = {}
    for q, (low, high) in ends.items():
        a, b = F.col(f"{q}l"), F.col(f"{q}h")
        out[q] = F.when(a == b, a).otherwise((high - place[q]) * a + (place[q] - low) * b)
    return found.select(*ks, *[c.alias(q) for q, c in out.items()])


class GroupBy:
    """Groups of a frame; null is a key like others."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str] = ()):
        require(df, keys)
        self.df, self.keys, self.order = df, keys, list(order)

    def agg(self, functions: dict[str, str]) -> DataFrame:
        """One function by column, whose result keeps the column's name; in the order given."""
        require(self.df, functions)
        require_unique([*self.keys, *functions])
        out = []
        for name, how in functions.items():
            kind = self.df.schema[name].dataType
            if how in NUMERIC and isinstance(kind, (StringType, BooleanType)):
                raise ValueError(f"{how} of {name}: {kind.simpleString()} is no number")
            if how in ("first", "last"):
                if not self.order:
                    raise ValueError(f"{how} needs an order key")
                out.append(getattr(E, how)(E.col(name), F.struct(*E.cols(*self.order))).alias(name))
            elif how in BY_NAME:
                exact = how in ("min", "max") and not isinstance(kind, NumericType)
                out.append((BY_NAME[how](E.col(name), keep_type=True) if exact else BY_NAME[how](E.col(name))).alias(name))
            else:
                raise ValueError(f"unknown aggregate {how!r}")
        return self.agg_exprs(*out)

    def agg_exprs(self, *exprs: Column) -> DataFrame:
        """Any aggregate expressions, each with an alias; medians and quantiles of numbers are spread over tasks."""
        if not exprs:
            return self.df.select(*E.cols(*self.keys)).distinct()
        spread = {} if self.df.isStreaming else {i: e for i, e in enumerate(exprs) if isinstance(e, E.Quantile) and e.called and isinstance(self.df.select(e.of).schema[0].dataType, NumericType)}
        if not spread:
            return self.df.groupBy(*E.cols(*self.keys)).agg(*exprs)
        kept = [e for i, e in enumerate(exprs) if i not in spread]
        keys = [F.col(f"__g{k}") for k in range(len(self.keys))]
        out = self.df.groupBy(*E.cols(*self.keys)).agg(*(kept or [F.count(F.lit(1)).alias("__rows")]))
        names = [*self.keys, *[out.columns[len(self.keys) + i] for i in range(len(kept))]]
        out = out.toDF(*[f"__g{k}" for k in range(len(self.keys))], *[f"__a{i}" for i in range(max(1, len(kept)))])
        for of in {id(e.of): e.of for e in spread.values()}.values():
            wanted = {f"__q{i}": e.p for i, e in spread.items() if e.of is of}
            found = quantiles(self.df.select(*[E.col(k).alias(f"__g{j}") for j, k in enumerate(self.keys)], of.alias("__v")), len(keys), wanted)
            out = _beside(out, found, [f"__g{k}" for k in range(len(keys))], "left")
        rest = iter(range(len(kept)))
        values = [F.col(f"__q{i}").alias(spread[i].called) if i in spread else next(rest) for i in range(len(exprs))]
        values = [F.col(f"__a{v}").alias(names[len(self.keys) + v]) if isinstance(v, int) else v for v in values]
        return out.select(*[k.alias(n) for k, n in zip(keys, self.keys, strict=True)], *values)

    def apply(self, function: Callable, schema: str) -> DataFrame:
        """A user function of each group's rows as a pandas frame; a group must fit a worker's memory."""
        return self.df.groupBy(*E.cols(*self.keys)).applyInPandas(function, schema)

    def rollup(self, *exprs: Column) -> DataFrame:
        return self.df.rollup(*E.cols(*self.keys)).agg(*exprs)

    def cube(self, *exprs: Column) -> DataFrame:
        return self.df.cube(*E.cols(*self.keys)).agg(*exprs)


def describe(df: DataFrame) -> DataFrame:
    """Rows count, mean, std, min and max of the numeric columns, as double; all in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not names:
        raise ValueError("no numeric column to describe")
    steps = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(E.col(c)).cast("double").alias(f"{k}_{i}") for k, f in steps.items() for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), *[F.col(f"{k}_{i}").alias(c) for i, c in enumerate(names)]) for k in steps])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def describe_column(df: DataFrame, name: str) -> str:
    """One line about a numeric column."""
    r = describe(df.select(E.col(name))).collect()
    return f"{name}: " + ", ".join(f"{x['statistic']}={x[name]}" for x in r)


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(E.col(c).isNull()).alias(c) for c in df.columns])
