"""Expressions: references, literals, arithmetic, comparison, conditions, casts, aggregates.

Every function returns a Column, so that the optimizer sees the whole plan.
Where row order matters, functions return an :class:`Ordered`, which a frame
binds to its order key (and, by ``over``, to a partition).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column
from pyspark.sql.functions.builtin import _invoke_function
from pyspark.sql.types import DataType

Value = Column | int | float | str | bool | None


def col(name: str) -> Column:
    """A reference to a column, by its exact name (dots included)."""
    return F.col(f"`{name.replace('`', '``')}`") if name != "*" else F.col("*")


def cols(*names: str) -> list[Column]:
    return [col(n) for n in names]


def all_cols() -> Column:
    return F.col("*")


def lit(value: Value) -> Column:
    """A literal: integers are long, floats double; the column is named ``literal``."""
    if isinstance(value, Column):
        return value
    if isinstance(value, bool) or value is None:
        out = F.lit(value)
    elif isinstance(value, int):
        out = F.lit(value).cast("long")
    elif isinstance(value, float):
        out = F.lit(value).cast("double")
    else:
        out = F.lit(value)
    return out.alias("literal")


def _c(x: Value) -> Column:
    """An operand: a Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x).cast("long") if isinstance(x, int) and not isinstance(x, bool) else F.lit(x)


# Arithmetic


def add(a: Value, b: Value) -> Column:
    return _c(a) + _c(b)


def sub(a: Value, b: Value) -> Column:
    return _c(a) - _c(b)


def mul(a: Value, b: Value) -> Column:
    return _c(a) * _c(b)


def div(a: Value, b: Value) -> Column:
    """Quotient of floats; a zero divisor gives null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def int_div(a: Value, b: Value) -> Column:
    """Quotient of integers, cut off towards zero; a zero divisor gives null."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a: Value, b: Value) -> Column:
    """Remainder with the sign of the dividend; a zero divisor gives null."""
    return F.try_mod(_c(a), _c(b))


def power(a: Value, b: Value) -> Column:
    return F.pow(_c(a), _c(b))


def neg(a: Value) -> Column:
    return -_c(a)


def abs_(a: Column) -> Column:
    return F.abs(a)


def sqrt(a: Column) -> Column:
    """Square root; NaN for negative numbers."""
    return F.sqrt(a)


def log(a: Column) -> Column:
    """Natural logarithm: -Infinity at 0, NaN below."""
    a = a.cast("double")
    return F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(F.log(a))


def exp(a: Column) -> Column:
    return F.exp(a)


def floor(a: Column) -> Column:
    return F.floor(a).cast("double")


def ceil(a: Column) -> Column:
    return F.ceil(a).cast("double")


def round_(a: Column, digits: int = 0) -> Column:
    """Half away from zero; negative digits round to tens."""
    return F.round(a, digits)


# Comparison and logic (three-valued, as in SQL)


def eq(a: Value, b: Value) -> Column:
    return _c(a) == _c(b)


def ne(a: Value, b: Value) -> Column:
    return _c(a) != _c(b)


def lt(a: Value, b: Value) -> Column:
    return _c(a) < _c(b)


def gt(a: Value, b: Value) -> Column:
    return _c(a) > _c(b)


def le(a: Value, b: Value) -> Column:
    return _c(a) <= _c(b)


def ge(a: Value, b: Value) -> Column:
    return _c(a) >= _c(b)


def and_(a: Column, b: Column, null_dominant: bool = False) -> Column:
    """Conjunction; with ``null_dominant`` a null operand makes it null, whatever the other."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b) if null_dominant else a & b


def or_(a: Column, b: Column, null_dominant: bool = False) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b) if null_dominant else a | b


def not_(a: Column) -> Column:
    return ~a


def is_null(a: Column) -> Column:
    return a.isNull()


def is_not_null(a: Column) -> Column:
    return a.isNotNull()


def is_in(a: Column, *values: Value) -> Column:
    """Membership; null stays null, and no values at all match nothing."""
    return a.isin(*values) if values else F.when(a.isNotNull(), F.lit(False))


def is_between(a: Column, low: Value, high: Value) -> Column:
    return a.between(_c(low), _c(high))


@dataclass(frozen=True)
class When:
    """``when(cond).then(a).otherwise(b)``; further ``when`` add branches."""

    branches: tuple[tuple[Column, Column], ...] = ()
    open: Column | None = None

    def when(self, cond: Column) -> When:
        return replace(self, open=cond)

    def then(self, value: Value) -> When:
        return When((*self.branches, (self.open, _c(value))))

    def _column(self) -> Column:
        (cond, value), *rest = self.branches
        out = F.when(cond, value)
        for cond, value in rest:
            out = out.when(cond, value)
        return out

    def otherwise(self, value: Value, null_condition: str = "else") -> Column:
        """The rest; with ``null_condition="null"`` a row whose condition is null gives null."""
        if null_condition == "null":
            known = self.branches[0][0].isNotNull()
            for cond, _ in self.branches[1:]:
                known &= cond.isNotNull()
            return F.when(known, self._column().otherwise(_c(value)))
        return self._column().otherwise(_c(value))

    def end(self) -> Column:
        """Without a rest: null."""
        return self._column()

    def alias(self, name: str) -> Column:
        return self._column().alias(name)


def when(cond: Column) -> When:
    return When(open=cond)


# Casts and nulls


def cast(a: Column, to: str | DataType) -> Column:
    """Strict: a value that can't be cast is an error (under ANSI mode)."""
    return a.cast(to)


def try_cast(a: Column, to: str | DataType) -> Column:
    """A value that can't be cast gives null."""
    return a.try_cast(to)


def fill_null(a: Column, value: Value) -> Column:
    return F.coalesce(a, _c(value))


# Aggregates; of numbers they are double, counts long


def sum_(a: Column) -> Column:
    return F.sum(a).cast("double")


def mean(a: Column) -> Column:
    return F.avg(a).cast("double")


def min_(a: Column, keep_type: bool = False) -> Column:
    """Smallest value, as double; ``keep_type`` for strings, dates and exact integers."""
    return F.min(a) if keep_type else F.min(a).cast("double")


def max_(a: Column, keep_type: bool = False) -> Column:
    return F.max(a) if keep_type else F.max(a).cast("double")


def count(a: Column | None = None) -> Column:
    """Values that aren't null, or rows."""
    return F.count(F.lit(1) if a is None else a)


def std(a: Column, ddof: int = 1) -> Column:
    return F.sqrt(var(a, ddof)) if ddof not in (0, 1) else F.stddev_samp(a) if ddof else F.stddev_pop(a)


def var(a: Column, ddof: int = 1) -> Column:
    """Variance with ``ddof`` degrees of freedom taken off; null if no more values than these."""
    if ddof in (0, 1):
        return F.var_samp(a) if ddof else F.var_pop(a)
    n = F.count(a)
    return F.when(n > ddof, F.var_pop(a) * n / (n - ddof))


def n_unique(a: Column) -> Column:
    return F.count_distinct(a)


class Quantile(ClassicColumn):
    """An exact quantile: Spark's aggregate, whose state holds all values of a group.

    ``of`` and ``p`` tell a grouping that has it as a whole column what to
    compute, so that it can spread a group's values over tasks instead.
    """

    def __init__(self, column: Column, of: Column, p: float, name: str | None):
        super().__init__(column._jc)
        self.of, self.p, self.called = of, p, name

    def alias(self, *names: str, **options) -> Column:
        out = super().alias(*names, **options)
        return Quantile(out, self.of, self.p, names[0]) if len(names) == 1 and not options else out


def median(a: Column) -> Column:
    return Quantile(F.median(a), a, 0.5, None)


def quantile(a: Column, p: float) -> Column:
    """Exact, interpolated linearly; null for p outside 0 to 1."""
    return Quantile(F.percentile(a, p), a, p, None) if 0 <= p <= 1 else F.max(F.lit(None).cast("double"))


def first(a: Column, order: Column | str) -> Column:
    """First value that isn't null by the order key."""
    order = col(order) if isinstance(order, str) else order
    return F.min_by(a, F.when(a.isNotNull(), order))


def last(a: Column, order: Column | str) -> Column:
    order = col(order) if isinstance(order, str) else order
    return F.max_by(a, F.when(a.isNotNull(), order))


def arg_min(a: Column, order: Column | str) -> Column:
    """Order key of the smallest value, of ties the first."""
    order = col(order) if isinstance(order, str) else order
    return F.min(F.when(a.isNotNull(), F.struct(a.alias("v"), order.alias("k"))))["k"]


def arg_max(a: Column, order: Column | str) -> Column:
    """Order key of the largest value, of ties the first (the key must be a number)."""
    order = col(order) if isinstance(order, str) else order
    return -F.max(F.when(a.isNotNull(), F.struct(a.alias("v"), (-order).alias("k"))))["k"]


def sort_by(a: Column, by: Column, descending: bool = False) -> Column:
    """The values of a column as a list, in the order of another one (nulls last); for lists that fit a row."""
    known = F.array_sort(F.collect_list(F.when(by.isNotNull(), F.struct(by.alias("k"), a.alias("v")))))
    values = F.transform(F.reverse(known) if descending else known, lambda x: x["v"])
    rest = F.transform(F.collect_list(F.when(by.isNull(), F.struct(a.alias("v")))), lambda x: x["v"])
    return F.concat(values, rest)


def over(aggregate: Column | str, *partition: str, of: Column | None = None) -> Column:
    """An aggregate of each row's partition; null keys form a partition.

    By name (sum, mean, min, max, of a column) it is double; other aggregate
    functions are given as Columns.
    """
    if not partition:
        raise ValueError("over() needs at least one partition column")
    w = Window.partitionBy(*cols(*partition))
    if isinstance(aggregate, str):
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}[aggregate](of).over(w).cast("double")
    return aggregate.over(w)


def n_unique_over(a: Column, *partition: str) -> Column:
    """Distinct values of each row's partition, nulls not counted (a window can't count distinct values itself).

    The last dense rank, from both ends: no set of values is held.
    """
    w = Window.partitionBy(*cols(*partition))
    both = F.dense_rank().over(w.orderBy(a.asc())) + F.dense_rank().over(w.orderBy(a.desc())) - 1
    return (both - F.max(a.isNull().cast("int")).over(w)).cast("long")


def used_columns(df: DataFrame, expression: Column) -> list[str]:
    """The columns of ``df`` that an expression reads, in the table's order; nothing is run."""
    df.select(expression)  # a name that isn't there at all is an error

    def missed(name: str) -> bool:
        try:
            df.drop(name).select(expression)
        except AnalysisException:
            return True
        return False

    return [c for c in df.columns if missed(c)]


def is_constant(df: DataFrame, expression: Column) -> bool:
    """Whether an expression reads no column of ``df``."""
    return not used_columns(df, expression)


@dataclass(frozen=True)
class Ordered:
    """An expression that depends on row order.

    ``build`` makes it from an ordered window. Without a partition, a frame
    spreads it over chunks of rows instead (:mod:`orrery.operators.ordered`), for
    which ``reach`` tells how many rows before and after it looks at, or ``kind``
    and ``value`` what is carried from chunk to chunk.
    """

    build: Callable[[WindowSpec], Column]
    reach: tuple[int, int] | None = None
    kind: str | None = None
    value: Column | None = None
    partition: tuple[str, ...] = ()
    name: str | None = None

    def over(self, *partition: str) -> Ordered:
        return replace(self, partition=partition)

    def alias(self, name: str) -> Ordered:
        return replace(self, name=name)

    def bind(self, order: list[Column]) -> Column:
        """The Column, for rows in this order, of one window for each partition."""
        w = Window.partitionBy(*cols(*self.partition)) if self.partition else Window.partitionBy()
        return self.build(w.orderBy(*order))


def shift(a: Column, n: int = 1) -> Ordered:
    """The value n rows before; negative n: after."""
    return Ordered(lambda w: F.lag(a, n).over(w) if n > 0 else F.lead(a, -n).over(w) if n < 0 else a, (max(n, 0), max(-n, 0)))


def diff(a: Column, n: int = 1) -> Ordered:
    n = max(1, n)
    return Ordered(lambda w: a - F.lag(a, n).over(w), (n, 0))


def pct_change(a: Column, n: int = 1) -> Ordered:
    """Relative change; null if the earlier value is null or 0."""
    n, d = max(1, n), a.cast("double")
    return Ordered(lambda w: F.try_divide(d - F.lag(d, n).over(w), F.lag(d, n).over(w)), (n, 0))


def _running(a: Column, kind: str) -> Ordered:
    f = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[kind]
    return Ordered(lambda w: F.when(a.isNotNull(), f(a).over(w.rowsBetween(Window.unboundedPreceding, 0))), kind=kind, value=a)


def cum_sum(a: Column) -> Ordered:
    """Running sum; null values stay null and don't reset it."""
    return _running(a, "sum")


def cum_prod(a: Column) -> Ordered:
    """Running product, as double."""
    return _running(a, "product")


def cum_min(a: Column) -> Ordered:
    return _running(a, "min")


def cum_max(a: Column) -> Ordered:
    return _running(a, "max")


def _rolling(a: Column, size: int, f: Callable[[Column], Column]) -> Ordered:
    """Over the last ``size`` rows; null for fewer rows or a null among them."""
    if size < 1:
        raise ValueError("a rolling window has at least one row")

    def build(w):
        frame = w.rowsBetween(1 - size, 0)
        return F.when(F.count(a).over(frame) == size, f(a).over(frame))

    return Ordered(build, (size - 1, 0))


def rolling_sum(a: Column, size: int) -> Ordered:
    return _rolling(a.cast("double"), size, F.sum)


def rolling_mean(a: Column, size: int) -> Ordered:
    return _rolling(a.cast("double"), size, F.avg)


def rolling_min(a: Column, size: int) -> Ordered:
    return _rolling(a.cast("double"), size, F.min)


def rolling_max(a: Column, size: int) -> Ordered:
    return _rolling(a.cast("double"), size, F.max)


def rolling_std(a: Column, size: int) -> Ordered:
    """With one degree of freedom taken off; 0 for windows of one row."""
    return _rolling(a.cast("double"), size, F.stddev_samp if size > 1 else F.stddev_pop)


def rank(a: Column, method: str = "average") -> Ordered:
    """Rank of the values among those that aren't null, as double: average, min, max, dense or ordinal (ties by row order)."""
    if method not in ("average", "min", "max", "dense", "ordinal"):
        raise ValueError(f"unknown rank method {method!r}")
    return Rank(build=None, kind=method, value=a)


class Rank(Ordered):
    """Ranks are ordered by the value itself, and by the frame's order for ordinal ranks only."""

    def bind(self, order: list[Column]) -> Column:
        keys = cols(*self.partition)
        by_value = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(self.value))
        if self.kind == "ordinal":
            out = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(self.value), *order))
        elif self.kind == "dense":
            out = F.dense_rank().over(by_value)
        else:
            same = F.count(F.lit(1)).over(Window.partitionBy(*keys, self.value))
            out = F.rank().over(by_value) + {"min": F.lit(0), "max": same - 1, "average": (same - 1) / 2}[self.kind]
        return F.when(self.value.isNotNull(), out.cast("double"))


def following(a: Column, w: WindowSpec) -> Column:
    """The first value that isn't null in the rows after, in one pass over the window's rows.

    A frame that ends at the last row would be read anew for every row, which is
    quadratic; ``lead`` goes on from value to value. ``pyspark`` has no argument for its IGNORE NULLS.
    """
    return _invoke_function("lead", _to_java_column(a), 1, None, True).over(w)


def interpolate(a: Column, method: str = "linear") -> Ordered:
    """Fill nulls: linear (between neighbours, double), pad or ffill (value before), bfill (value after)."""

    def build(w):
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        if method in ("pad", "ffill"):
            return F.last(a, True).over(before)
        if method == "bfill":
            return F.coalesce(a, following(a, w))
        at = F.row_number().over(w)
        known = F.when(a.isNotNull(), at)
        x0, x1 = F.last(known, True).over(before), following(known, w)
        y0, y1 = F.last(a, True).over(before).cast("double"), following(a, w).cast("double")
        return between(a, at, x0, y0, x1, y1)

    if method not in ("linear", "pad", "ffill", "bfill"):
        raise ValueError(f"unknown method {method!r}")
    return Ordered(build, kind={"pad": "ffill"}.get(method, method), value=a)


def between(a: Column, at: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``a``, or where it is null the point at ``at`` on the line between two known ones."""
    return F.when(a.isNotNull(), a.cast("double")).otherwise(y0 + (y1 - y0) * F.try_divide((at - x0).cast("double"), (x1 - x0).cast("double")))
