"""Frame: a DataFrame with an order key and the verbs of a typed, immutable table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .functions.expr import Ordered, col, cols
from .operators import grouping, joins, ordered, relational, reshape
from .sources import memory
from .sources.memory import RID


class Frame:
    """An immutable table; every verb returns a new one and nothing runs before an action.

    ``order`` names the columns that define the row order, for the verbs that
    depend on it. A frame made from values carries its row number.
    """

    def __init__(self, df: DataFrame, order: list[str] | str = ()):
        relational.require_unique(df.columns)
        self.order = [order] if isinstance(order, str) else list(order)
        relational.require(df, self.order)
        self._df = df

    # Construction

    @classmethod
    def create(cls, spark: SparkSession, columns: dict[str, tuple[str, list]]) -> Frame:
        """From (type, values) by name."""
        return cls(memory.from_columns(spark, columns), RID)

    @classmethod
    def zeros(cls, spark: SparkSession, schema: StructType, height: int = 0) -> Frame:
        return cls(memory.from_schema(spark, schema, height))

    def _with(self, df: DataFrame, order: list[str] | None = None) -> Frame:
        order = self.order if order is None else order
        return Frame(df, order if all(o in df.columns for o in order) else [])

    def ordered_by(self, *names: str) -> Frame:
        return Frame(self._df, list(names))

    def _key(self, what: str) -> list[str]:
        if not self.order:
            raise ValueError(f"{what} depends on the row order: give the frame an order key with ordered_by()")
        return self.order

    @property
    def _hidden(self) -> list[str]:
        return [RID] if RID in self._df.columns else []

    # Access

    @property
    def df(self) -> DataFrame:
        """The columns as a DataFrame, without the row number."""
        return self._df.drop(*self._hidden)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c not in self._hidden]

    @property
    def schema(self) -> StructType:
        return self.df.schema

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def height(self) -> int:
        return self._df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def is_empty(self) -> bool:
        return self._df.isEmpty()

    def clone(self) -> Frame:
        return self

    def column(self, name: str) -> Frame:
        return self.select(name)

    def column_by_index(self, i: int) -> Frame:
        return self.select(self.columns[i])

    # Columns

    def select(self, *items: str | Column) -> Frame:
        return self._with(relational.select(self._df, *items, *self._hidden))

    def with_columns(self, exprs: dict[str, Column | Ordered], one_task: bool = False) -> Frame:
        """Columns replaced or appended; all expressions see the frame as it was.

        Those that depend on the row order use one window for each partition;
        without a partition they are spread over chunks of rows, or with
        ``one_task`` (for small frames) put into a single window.
        """
        late = {n: e for n, e in exprs.items() if isinstance(e, Ordered)}
        plain = {n: e for n, e in exprs.items() if n not in late}
        if not late:
            return self._with(relational.with_columns(self._df, plain))
        key = cols(*self._key("the expression"))
        bound = {n: e.bind([F.asc_nulls_last(k) for k in key]) for n, e in late.items() if e.partition or one_task}
        wide = {n: e for n, e in late.items() if n not in bound}
        names = [*self._df.columns, *[n for n in exprs if n not in self._df.columns]]
        out = self._df.withColumns({f"__x{i}": e for i, e in enumerate([*plain.values(), *bound.values()])})
        made = dict(zip([*plain, *bound], [f"__x{i}" for i in range(len(plain) + len(bound))], strict=True))
        if wide:
            out = ordered.evaluate(out, key, {f"__w{i}": e for i, e in enumerate(wide.values())})
            made |= {n: f"__w{i}" for i, n in enumerate(wide)}
        return self._with(out.select(*[(F.col(made[n]) if n in made else col(n)).alias(n) for n in names]))

    def with_column(self, name: str, expr: Column | Ordered) -> Frame:
        return self.with_columns({name: expr})

    def drop(self, *names: str) -> Frame:
        return self._with(relational.drop(self._df, *names))

    def rename(self, old: str, new: str) -> Frame:
        return self._with(relational.rename(self._df, old, new), [new if o == old else o for o in self.order])

    def rename_each(self, change: Callable[[str], str]) -> Frame:
        out = self._df
        names = [c if c in self._hidden else change(c) for c in out.columns]
        relational.require_unique(names)
        at = dict(zip(out.columns, names, strict=True))
        return self._with(out.toDF(*names), [at[o] for o in self.order])

    def filter(self, condition: Column) -> Frame:
        return self._with(self._df.filter(condition))

    def drop_nulls(self, *subset: str) -> Frame:
        return self._with(relational.drop_nulls(self._df, list(subset) or self.columns))

    def fill_null(self, values: dict) -> Frame:
        return self._with(relational.fill_null(self._df, values))

    # Rows

    def sort(self, by: str | list[str], descending: bool | list[bool] = False) -> Frame:
        return self._with(relational.sort(self._df, by, descending, self.order))

    sort_by = sort

    def head(self, n: int = 5) -> Frame:
        return self._with(relational.head(self._df, n, self._key("head")))

    limit = head

    def tail(self, n: int = 5) -> Frame:
        return self._with(relational.tail(self._df, n, self._key("tail")))

    def slice(self, start: int, end: int) -> Frame:
        return self._with(relational.slice_(self._df, start, end, self._key("slice")))

    def gather(self, positions: list[int]) -> Frame:
        """Rows at the positions, in their order; an index outside the frame is an error."""
        n = self.height
        if any(not 0 <= p < n for p in positions):
            raise IndexError(f"positions lie between 0 and {n - 1}")
        at = self._df.sparkSession.createDataFrame(list(enumerate(positions)), "pos long, idx long")
        return Frame(relational.gather(self._df, at, self._key("gather")).drop(*self._hidden))

    def top_k(self, by: str, k: int, descending: bool = True) -> Frame:
        return self._with(relational.top_k(self._df, by, k, self.order, descending))

    def sample(self, n: int, seed: int = 0) -> Frame:
        return self._with(relational.sample(self._df, n, seed))

    def sample_fraction(self, fraction: float, seed: int = 0) -> Frame:
        return self._with(relational.sample_fraction(self._df, fraction, seed))

    def unique(self, *subset: str) -> Frame:
        """Distinct rows; the first one of those equal in the subset."""
        keys = list(subset) or [c for c in self.columns if c not in self.order] or self.columns
        return self._with(relational.unique(self._df, keys, self._key("unique")))

    def is_duplicated(self, name: str) -> Frame:
        return self._with(relational.is_duplicated(self._df, name))

    def unique_values(self, name: str) -> Frame:
        return Frame(relational.unique_values(self._df, name, self.order))

    # Groups, joins, shape

    def group_by(self, *keys: str) -> grouping.GroupBy:
        return grouping.GroupBy(self._df, list(keys), self.order)

    def join(self, other: Frame, on=None, how: str = "inner", **options) -> Frame:
        out = joins.join(self._df, other.df, on, how, **options)
        return self._with(out)

    def concat(self, *others: Frame) -> Frame:
        return Frame(relational.concat(self.df, *[o.df for o in others]))

    def concat_horizontal(self, *others: Frame) -> Frame:
        frames = [self, *others]
        parts = []
        for i, f in enumerate(frames):
            key = f._key("horizontal concatenation")
            parts.append((f._df.withColumnRenamed(RID, f"{RID}{i}"), [f"{RID}{i}" if o == RID else o for o in key]))
        out = relational.concat_horizontal(*parts)
        return Frame(out.drop(*[f"{RID}{i}" for i in range(len(frames))]))

    def pivot(self, index: str | list[str], columns: str, values: str, headers: list | None = None) -> Frame:
        return Frame(reshape.pivot(self._df, index, columns, values, self._key("pivot"), headers))

    def unpivot(self, ids: list[str], values: list[str]) -> Frame:
        return Frame(reshape.unpivot(self.df, ids, values))

    def transpose(self) -> Frame:
        return Frame(reshape.transpose(self._df, self._key("transpose")))

    def explode(self, name: str, sep: str = ",") -> Frame:
        return self._with(reshape.explode(self._df, name, sep))

    def describe(self) -> Frame:
        return Frame(grouping.describe(self.df))

    def null_counts(self) -> Row:
        return grouping.null_counts(self.df).first()

    # User functions

    def map_rows(self, name: str, function: Callable[[dict], object], kind: str) -> Frame:
        """A column from a function of each row as a dict; rows go to Python in Arrow batches. Nulls are None, and NaN is NaN."""
        names = self.columns
        out = self._df.drop(name)
        schema = StructType([*out.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])
        target = to_arrow_type(schema.fields[-1].dataType)
        kept = out.columns

        def run(batches):
            for batch in batches:
                values = [function(dict(zip(names, row, strict=True))) for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, target, from_pandas=False)], [*kept, name])

        return self._with(self._df.mapInArrow(run, schema))

    def map_batches(self, name: str, function: Callable[..., pd.Series], kind: str, *inputs: str) -> Frame:
        """A column from a function of batches of columns (row by row; batches are cut anywhere)."""
        return self._with(self._df.withColumn(name, F.pandas_udf(lambda *s: function(*s), kind)(*cols(*(inputs or self.columns)))))

    # Results

    def _sorted(self) -> DataFrame:
        return self._df.orderBy(*relational.sort_keys(self.order, [False] * len(self.order))) if self.order else self._df

    def rows(self) -> Iterator[Row]:
        """Rows in order, partition by partition."""
        return self._sorted().drop(*self._hidden).toLocalIterator()

    def to_dicts(self) -> list[dict]:
        return [r.asDict() for r in self._sorted().drop(*self._hidden).collect()]

    def to_dict(self) -> dict[str, list]:
        rows = self.to_dicts()
        return {c: [r[c] for r in rows] for c in self.columns}

    def row(self, i: int) -> dict:
        found = self.slice(i, i + 1).to_dicts()
        if i < 0 or not found:
            raise IndexError(f"there is no row {i}")
        return found[0]

    def value(self, i: int, name: str):
        """One value, by its row's number and its column."""
        relational.require(self._df, [name])
        return self.row(i)[name]

    def equals(self, other: Frame) -> bool:
        """Same columns and types, and the same rows: in order where the frames have one. NaN equals NaN, null null.

        Rows are compared by Spark; of rows that tie in the order, any order will do.
        """
        if self.schema != other.schema or bool(self.order) != bool(other.order):
            return False
        a, b = self._df, other._df
        if self.order:
            # Rows come into line by number; where the keys themselves are compared, the rows alone say enough.
            keyed = self.order == other.order and not self._hidden and not other._hidden
            a, b = (x.df if keyed else ordered.number_rows(x._df, cols(*x.order), "__at").drop(*x._hidden) for x in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __str__(self) -> str:
        return self.to_string()

    def to_string(self, most: int = 20, ends: int = 5) -> str:
        """A table as text: names, types and all rows up to ``most``, else the first and last ``ends`` of them."""
        names, height = self.columns, self.height
        source = self._sorted().drop(*self._hidden)
        text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        rows = [[text(v) for v in r] for r in (source.collect() if height <= most else source.take(ends))]
        if height > most:
            rows += [["..."] * len(names)] + [[text(v) for v in r] for r in source.tail(ends)]
        head = [names, [f.dataType.simpleString() for f in self.schema.fields]]
        width = [max(map(len, x)) for x in zip(*head, *rows, strict=True)]
        line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
        rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        return "\n".join([f"shape: ({height}, {len(names)})", rule, *map(line, head), rule, *map(line, rows), rule])

    def show(self, n: int = 20) -> None:
        self._sorted().drop(*self._hidden).show(n)

    def glimpse(self, n: int = 5) -> str:
        """A line for each column: its name, type and first values."""
        rows = self._sorted().drop(*self._hidden).take(n)
        return "\n".join(f"{f.name} <{f.dataType.simpleString()}> {', '.join(repr(r[f.name]) for r in rows)}" for f in self.schema.fields)

    def explain(self, mode: str = "formatted") -> str:
        from .plans.inspect import plan_text

        return plan_text(self.df, mode)

    def collect(self, tag: str | None = None) -> list[Row]:
        """The rows; with a tag, ``spark.interruptTag(tag)`` from another thread cancels the run."""
        spark = self._df.sparkSession
        if tag:
            spark.addTag(tag)
        try:
            return self._sorted().drop(*self._hidden).collect()
        finally:
            if tag:
                spark.removeTag(tag)
