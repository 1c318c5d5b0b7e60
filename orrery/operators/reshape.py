"""Pivot, unpivot, transpose and explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..functions.expr import col, cols
from .ordered import number_rows
from .relational import require, require_unique

#: Headers that a pivot finds by itself at most, and rows of a frame that is transposed.
MOST_HEADERS = 10_000


def pivot(df: DataFrame, index: str | list[str], columns: str, values: str, order: list[str], headers: list | None = None) -> DataFrame:
    """A row for each index, a column for each header with the first value by the order key; null's header is ``null``.

    Without ``headers`` they are looked up first, in order of first occurrence.
    """
    index = [index] if isinstance(index, str) else list(index)
    require(df, [*index, columns, values, *order])
    key = F.struct(*cols(*order))
    if headers is None:
        found = df.groupBy(col(columns).alias("h")).agg(F.min(key).alias("o")).orderBy("o").limit(MOST_HEADERS + 1).collect()
        if len(found) > MOST_HEADERS:
            raise ValueError(f"column {columns} has more than {MOST_HEADERS} headers")
        headers = [r["h"] for r in found]
    # The first value is taken even if it is null, so the value is wrapped.
    picked = [F.min_by(F.struct(col(values).alias("v")), F.when(col(columns).eqNullSafe(F.lit(h)), key))["v"].alias("null" if h is None else str(h)) for h in headers]
    require_unique([*index, *["null" if h is None else str(h) for h in headers]])
    return df.groupBy(*cols(*index)).agg(*picked) if picked else df.select(*cols(*index)).distinct()


def unpivot(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """A row for each of the value columns; whole numbers and floats become double."""
    require(df, [*ids, *values])
    return df.unpivot(cols(*ids), cols(*values), variable, value)


def transpose(df: DataFrame, order: list[str]) -> DataFrame:
    """A row for each column: its name in ``column``, its values in ``column_0``, ``column_1`` and so on; numbers become double.

    For frames of few rows, as each becomes a column.
    """
    names = [c for c in df.columns if c not in order or len(df.columns) == len(order)]
    numeric = [isinstance(df.schema[c].dataType, NumericType) for c in names]
    if any(numeric) and not all(numeric):
        raise ValueError("numbers and other types can't be transposed together")
    if not all(numeric) and len({df.schema[c].dataType for c in names}) > 1:
        raise ValueError("columns of different types can't be transposed")
    kind = "double" if all(numeric) else df.schema[names[0]].dataType
    n = df.limit(MOST_HEADERS + 1).count()
    if n > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} rows can't become columns")
    numbered = number_rows(df, cols(*order)).select("__rn", *[col(c).cast(kind).alias(c) for c in names])
    cells = numbered.select("__rn", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), col(c).alias("v")) for i, c in enumerate(names)])).alias("x")).select("__rn", "x.*")
    out = cells.groupBy("i", "column").agg(*[F.max(F.when(F.col("__rn") == k + 1, F.col("v"))).alias(f"column_{k}") for k in range(n)])
    return out.orderBy("i").drop("i")


def explode(df: DataFrame, name: str, sep: str = ",") -> DataFrame:
    """A row for each part of a text (trimmed) or element of an array; rows of null stay."""
    require(df, [name])
    if isinstance(df.schema[name].dataType, ArrayType):
        parts = col(name)
    else:
        parts = F.transform(F.split(col(name), f"\\Q{sep}\\E", -1), lambda x: F.trim(x))
    other = [c for c in df.columns if c != name]
    return df.select(*cols(*other), F.explode_outer(parts).alias(name)).select(*cols(*df.columns))
