"""CSV: reading with type inference on the first values, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col
from ..operators.relational import require
from .files import single_file

# Texts that mean null by default, and texts of booleans.
NULLS = ("", "null", "NULL", "NA", "N/A", "NaN", "nan")
TRUE, FALSE = ("true", "True", "TRUE", "1"), ("false", "False", "FALSE", "0")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    quote: str = '"',
    header: bool = True,
    null_values: tuple[str, ...] = NULLS,
    columns: list[str] | None = None,
    dtypes: dict[str, str] | None = None,
    infer_length: int = 100,
    skip_rows: int = 0,
    skip_rows_after_header: int = 0,
    n_rows: int = 0,
    comment: str | None = None,
) -> DataFrame:
    """A CSV file with typed columns.

    Types not given are found on the first ``infer_length`` rows (all, if not
    positive), in the order boolean (also of 0 and 1 only), long, double,
    string. A value further on that doesn't fit its column is an error. Without
    header the columns are named column_0, column_1 and so on. ``skip_rows``
    are left out before the header, of a single file.
    """
    # Whatever doesn't occur in a text: nulls are recognized here, from several texts.
    options = {"sep": sep, "quote": quote, "escape": quote, "nullValue": "\0", "emptyValue": "", "mode": "PERMISSIVE", "enforceSchema": "true"}
    if comment:
        options["comment"] = comment
    skipped = skip_rows + skip_rows_after_header
    if skipped:
        lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
        first = lines.filter(F.col("n") >= skip_rows).orderBy("n").limit(1).select("value")
        top = spark.read.options(**options).csv(first.rdd.map(lambda r: r[0])).first()
        names = [str(x or "") for x in top] if header else [f"column_{i}" for i in range(len(top))]
        body = lines.filter(F.col("n") >= skipped + int(header)).filter("value <> ''")
        if comment:
            body = body.filter(~F.startswith("value", F.lit(comment)))
        fields = ", ".join(f"`{i}` string" for i in range(len(names)))
        raw = body.select(F.from_csv("value", F.lit(fields), options).alias("r")).select("r.*").toDF(*names)
    else:
        raw = spark.read.options(header=str(header).lower(), inferSchema="false", **options).csv(path)
        if not header:
            raw = raw.toDF(*[f"column_{i}" for i in range(len(raw.columns))])
    if columns is not None:
        require(raw, columns)
        raw = raw.select(*[col(c) for c in columns])
    if n_rows > 0:
        raw = raw.limit(n_rows)
    null = list(null_values)
    raw = raw.select(*[F.when(~col(c).isin(null), col(c)).alias(c) if null else col(c) for c in raw.columns])
    kinds = dict(dtypes or {})
    require(raw, [c for c in kinds if columns is None or c in columns])
    kinds |= infer(raw.select(*[col(c) for c in raw.columns if c not in kinds]), infer_length)
    return raw.select(*[typed(col(c), kinds[c]).alias(c) for c in raw.columns])


def scan_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """As :func:`read_csv`; the frame is lazy, and Spark pushes filters and columns into the scan."""
    return read_csv(spark, path, **options)


def typed(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False).when(c.isNotNull(), c.cast("boolean"))
    return c.cast(kind)


def infer(df: DataFrame, length: int = 100) -> dict[str, str]:
    """The type of each text column by its first values, found in one pass."""
    if not df.columns:
        return {}
    sample = df.limit(length) if length > 0 else df
    tests = {"boolean": lambda c: c.isin(*TRUE, *FALSE), "bigint": lambda c: c.try_cast("bigint").isNotNull() & F.rlike(c, F.lit(r"^[+-]?\d+$")), "double": lambda c: c.try_cast("double").isNotNull()}
    found = sample.agg(*[F.count_if(c.isNotNull() & ~t(c)).alias(f"{k}_{i}") for i, c in enumerate(map(col, df.columns)) for k, t in tests.items()], *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)]).first()
    return {c: next((k for k in tests if found[f"n_{i}"] and not found[f"{k}_{i}"]), "string") for i, c in enumerate(df.columns)}


def write_csv(df: DataFrame, path: str, sep: str = ",", null_value: str = "", header: bool = True, quote_all: bool = False, single: bool = False) -> None:
    """A folder of CSV files, or with ``single`` one file. All simple types are written, nulls as ``null_value``."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite").options(sep=sep, nullValue=null_value, header=str(header).lower(), quoteAll=str(quote_all).lower(), escape='"', emptyValue='""')
    if single:
        single_file(df.sparkSession, lambda to: writer.csv(to), path)
    else:
        writer.csv(path)
