"""Projection, filtering, sorting, selection, distinct rows and concatenation on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, cols
from .ordered import number_rows


def require(df: DataFrame, names) -> None:
    """An error that names the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def require_unique(names) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"column names occur twice: {', '.join(twice)}")


def select(df: DataFrame, *items: str | Column) -> DataFrame:
    """Columns by name, or expressions."""
    require(df, [x for x in items if isinstance(x, str)])
    out = df.select(*[col(x) if isinstance(x, str) else x for x in items])
    require_unique(out.columns)
    return out


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Columns replaced in place or appended; all expressions see the frame as it was."""
    return df.withColumns(exprs)


def drop(df: DataFrame, *names: str) -> DataFrame:
    require(df, names)
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, [old])
    if new != old and new in df.columns:
        raise ValueError(f"column {new} exists already")
    return df.withColumnRenamed(old, new)


def rename_each(df: DataFrame, change) -> DataFrame:
    """All names through a function, such as one that adds a prefix or suffix."""
    names = [change(c) for c in df.columns]
    require_unique(names)
    return df.toDF(*names)


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without null (NaN is a value)."""
    require(df, subset or [])
    return df.filter(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in subset or df.columns]))


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced by column; the column's type stays."""
    require(df, values)
    return df.withColumns({c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def sort_keys(by: list[str | Column], descending: list[bool]) -> list[Column]:
    """Sort keys with nulls last in both directions."""
    if len(by) != len(descending):
        raise ValueError(f"{len(by)} sort keys, {len(descending)} directions")
    keys = [col(b) if isinstance(b, str) else b for b in by]
    return [F.desc_nulls_last(k) if d else F.asc_nulls_last(k) for k, d in zip(keys, descending, strict=True)]


def sort(df: DataFrame, by: str | list[str], descending: bool | list[bool] = False, order: list[str] = ()) -> DataFrame:
    """Sorted, nulls last; rows of equal keys stay in the order of ``order``."""
    by = [by] if isinstance(by, str) else list(by)
    descending = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    require(df, by)
    return df.orderBy(*sort_keys(by, descending), *[F.asc_nulls_last(col(o)) for o in order if o not in by])


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows by the order key (planned as one top-n operator)."""
    return df.orderBy(*sort_keys(order, [False] * len(order))).limit(max(0, n))


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Last n rows, in order."""
    back = [F.desc_nulls_first(col(o)) for o in order]
    return df.orderBy(*back).limit(max(0, n)).orderBy(*sort_keys(order, [False] * len(order)))


def slice_(df: DataFrame, start: int, end: int, order: list[str]) -> DataFrame:
    """Rows start to end (from 0, end left out), cut to the frame."""
    start = max(0, start)
    return df.orderBy(*sort_keys(order, [False] * len(order))).offset(start).limit(max(0, end - start))


def top_k(df: DataFrame, by: str, k: int, order: list[str] = (), descending: bool = True) -> DataFrame:
    return sort(df, by, descending, order).limit(max(0, k))


def top_k_per_group(df: DataFrame, keys: list[str], by: str, k: int, order: list[str] = (), descending: bool = True) -> DataFrame:
    """The first k rows of each group; Spark limits the groups before they are exchanged."""
    w = Window.partitionBy(*cols(*keys)).orderBy(*sort_keys([by, *order], [descending, *[False] * len(order)]))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def gather(df: DataFrame, positions: DataFrame, order: list[str], at: str = "idx", to: str = "pos") -> DataFrame:
    """Rows at positions (from 0), repeated and ordered as ``positions`` has them (columns idx and pos)."""
    numbered = number_rows(df, cols(*order)).withColumn("__rn", F.col("__rn") - 1)
    return positions.join(numbered, F.col(at) == F.col("__rn")).drop("__rn", at).orderBy(to).drop(to)


def arg_sort(df: DataFrame, by: str, order: list[str], descending: bool = False) -> DataFrame:
    """The row numbers (from 0) in sorted order, as ``idx`` with their place ``pos``."""
    numbered = number_rows(df, cols(*order)).select((F.col("__rn") - 1).alias("idx"), col(by).alias("__v"))
    if descending:
        keys = number_rows(numbered.select("__v").distinct(), [F.col("__v")], "__r").select(F.col("__v").alias("__k"), F.when(F.col("__v").isNotNull(), -F.col("__r")).alias("__r"))
        numbered = numbered.join(keys, numbered["__v"].eqNullSafe(keys["__k"])).withColumn("__v", F.col("__r"))
    return number_rows(numbered.select("idx", "__v"), [F.col("__v"), F.col("idx")], "pos").select("idx", (F.col("pos") - 1).alias("pos"))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` with its present physical plan, so that each run has the same partitions, whatever columns are read of it."""
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


#: Equal ranges of random numbers that rows are counted by; one of them is then looked at closely.
RANGES = 65536


def _drawn(df: DataFrame, size: Callable[[int], int], seed: int) -> DataFrame:
    """Exactly as many rows as ``size`` makes of their number: those of the smallest random numbers.

    The largest of these is found first, by counts of ranges of numbers and then
    the numbers of one range (one of 65,536 rows). Rows are then filtered where
    they are; a sort with a limit would bring all of the sample into one task.
    """
    base = pinned(df)
    while True:
        drawn = base.withColumn("__r", F.rand(seed))
        part = F.floor(F.col("__r") * RANGES)
        counts = sorted(map(tuple, drawn.groupBy(part).count().collect()))
        n = size(sum(c for _, c in counts))
        if n == 0:
            return drawn.filter("__r < 0").drop("__r")
        left = n
        for at, c in counts:
            if c >= left:
                break
            left -= c
        numbers = sorted(r[0] for r in drawn.filter(part == at).select("__r").collect())
        if left == len(numbers) or numbers[left] > numbers[left - 1]:
            return drawn.filter(F.col("__r") <= F.lit(numbers[left - 1])).drop("__r")
        seed += 1  # two rows drew the same last number


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement; more than there are is an error."""

    def size(rows: int) -> int:
        if n > rows:
            raise ValueError(f"a sample of {n} rows is larger than the frame")
        return max(0, n)

    return _drawn(df, size, seed)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the rows, rounded to whole ones."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction lies between 0 and 1, not {fraction}")
    return _drawn(df, lambda rows: int(rows * fraction + 0.5), seed)


def unique(df: DataFrame, subset: list[str] | None = None, order: list[str] = ()) -> DataFrame:
    """Distinct rows; of rows equal in ``subset`` the first by the order key.

    Rows are combined before the exchange: the first row of each key is a
    minimum over (order key, row), not a sort of the whole group.
    """
    if not subset:
        return df.dropDuplicates()
    require(df, subset)
    if not order:
        raise ValueError("the first of equal rows needs an order key")
    rest = [c for c in df.columns if c not in subset]
    ranked = F.struct(*[F.struct(col(o).isNull(), col(o)).alias(f"o{i}") for i, o in enumerate(order)], *[col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*cols(*subset)).agg(F.min(ranked).alias("__first"))
    out = best.select(*cols(*subset), *[F.col("__first")[f"c{i}"].alias(c) for i, c in enumerate(rest)])
    return out.select(*cols(*df.columns))


def unique_values(df: DataFrame, name: str, order: list[str] = ()) -> DataFrame:
    """Distinct values of a column (null once), in order of first occurrence if there is an order key."""
    require(df, [name])
    if not order:
        return df.select(col(name)).distinct()
    first = F.min(F.struct(*cols(*order)))
    return df.groupBy(col(name)).agg(first.alias("__o")).orderBy("__o").select(col(name))


def is_duplicated(df: DataFrame, name: str, out: str = "is_duplicated") -> DataFrame:
    """Whether each row's value occurs more than once; nulls are equal.

    Values are counted with combining before the exchange and joined back, so
    that a value that fills a third of the table doesn't sit in one window.
    """
    require(df, [name])
    twice = df.groupBy(col(name).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__k", F.lit(True).alias("__d"))
    return df.join(twice, col(name).eqNullSafe(F.col("__k")), "left").withColumn(out, F.coalesce("__d", F.lit(False))).drop("__k", "__d")


def concat(*frames: DataFrame) -> DataFrame:
    """Rows below each other; names and types must agree exactly."""
    if not frames:
        raise ValueError("nothing to concatenate")
    kinds = [[(f.name, f.dataType) for f in x.schema.fields] for x in frames]
    for k, kind in enumerate(kinds[1:], 2):
        if kind != kinds[0]:
            raise ValueError(f"frame {k} has {kind}, the first one {kinds[0]}")
    return reduce(lambda a, b: a.union(b), frames)


def concat_horizontal(*frames: tuple[DataFrame, list[str]]) -> DataFrame:
    """Columns beside each other, rows by number in each frame's order; names must differ, heights must not."""
    require_unique([c for df, _ in frames for c in df.columns])
    heights = {df.count() for df, _ in frames}
    if len(heights) > 1:
        raise ValueError(f"frames differ in height: {sorted(heights)}")
    return reduce(lambda a, b: a.join(b, "__rn"), [number_rows(df, cols(*order)) for df, order in frames]).orderBy("__rn").drop("__rn")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return concat(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
