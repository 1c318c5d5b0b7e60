"""JSON (an array of objects) and NDJSON (an object on each line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DayTimeIntervalType, DoubleType, FloatType, MapType, NullType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..functions.expr import col
from .files import joined_file, single_file

#: Objects whose keys tell the order of the columns.
ORDER_ROWS = 100


def _read(spark: SparkSession, path: str, multi_line: bool, nested: bool, keys: list[str]) -> DataFrame:
    df = spark.read.option("multiLine", str(multi_line).lower()).json(path)
    schema = df.schema
    texts = (NullType,) if nested else (NullType, StructType, ArrayType, MapType)
    plain = StructType([StructField(f.name, StringType() if isinstance(f.dataType, texts) else f.dataType, True) for f in schema.fields])
    if plain != schema:
        # Read as a string, a nested value is its JSON text.
        df = spark.read.schema(plain).option("multiLine", str(multi_line).lower()).json(path)
    first = [k for k in keys if k in df.columns]
    return df.select(*[col(c) for c in [*first, *[c for c in df.columns if c not in first]]])


def _keys(objects: DataFrame) -> list[str]:
    out: dict[str, None] = {}
    for r in objects.select(F.json_object_keys("value").alias("k")).limit(ORDER_ROWS).collect():
        out.update(dict.fromkeys(r["k"] or []))
    return list(out)


def read_json(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """An array of objects. Columns in order of first occurrence; missing keys are null, columns of null only are strings.

    Whole and broken numbers of one column become double. Nested values are
    JSON text, or with ``nested`` structs and arrays.
    """
    text = spark.read.option("wholetext", "true").text(path)
    objects = text.select(F.explode(F.slice(F.from_json("value", "array<string>"), 1, ORDER_ROWS)).alias("value"))
    return _read(spark, path, True, nested, _keys(objects))


def read_ndjson(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """An object on each line, by the rules of :func:`read_json`; read in parallel."""
    return _read(spark, path, False, nested, _keys(spark.read.text(path).filter("trim(value) <> ''")))


def encoded(df: DataFrame) -> DataFrame:
    """Values as JSON has them: NaN and infinities null, dates and times as text, durations as microseconds with unit."""

    def one(f: StructField) -> Column:
        c, kind = col(f.name), f.dataType
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        if isinstance(kind, DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, DayTimeIntervalType):
            return F.concat((c.cast("decimal(20,6)") * 1_000_000).cast("bigint").cast("string"), F.lit("us"))
        return c

    return df.select(*[one(f).alias(f.name) for f in df.schema.fields])


def time_text(ns: Column) -> Column:
    """A time of day, kept as nanoseconds since midnight, as HH:MM:SS with its fraction if any."""
    seconds = F.floor(ns / 1_000_000_000)
    clock = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")
    fraction = F.pmod(ns, F.lit(1_000_000_000))
    return F.when(fraction == 0, clock).otherwise(F.concat(clock, F.lit("."), F.lpad(fraction.cast("string"), 9, "0")))


def write_json(df: DataFrame, path: str) -> None:
    """One array in one file: objects are written in parallel, in parts, whose bytes are then copied one after another."""
    objects = encoded(df).select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))
    joined_file(df.sparkSession, lambda to: objects.write.text(to), path, b"[", b"]", skip=1)  # the first comma


def write_ndjson(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of files of an object on each line, nulls included, or with ``single`` one file."""
    out = encoded(df)
    if single:
        single_file(df.sparkSession, lambda to: out.coalesce(1).write.option("ignoreNullFields", "false").json(to), path)
    else:
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
