"""Frames from values in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DayTimeIntervalType, NumericType, StructField, StructType, TimestampNTZType, TimestampType, _parse_datatype_string

#: The row number of a frame made from values; it is the frame's order key.
RID = "__rid"

# Types without a counterpart of the same sign and width are widened by one step.
UNSIGNED = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}


def kind_of(name: str | DataType) -> DataType:
    """A type by name: int8 to int64, uint8 to uint64, float32, float64, boolean, string, date, datetime, duration, or Spark's own names."""
    if isinstance(name, DataType):
        return name
    plain = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "datetime": "timestamp_ntz", "time": "bigint", "duration": "interval day to second"} | UNSIGNED
    return _parse_datatype_string(plain.get(name.lower(), name))


def from_columns(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A frame from (type, values) by name, with its row number in ``__rid``; None is null. Ragged columns are an error."""
    heights = {n: len(v) for n, (_, v) in columns.items()}
    if len(set(heights.values())) > 1:
        raise ValueError(f"columns differ in length: {heights}")
    kinds = {n: kind_of(t) for n, (t, _) in columns.items()}
    schema = StructType([StructField(RID, kind_of("bigint"), False), *[StructField(n, k, True) for n, k in kinds.items()]])
    fit = [_fit(k) for k in kinds.values()]
    rows = [(i, *[f(x) for f, x in zip(fit, r, strict=True)]) for i, r in enumerate(zip(*[v for _, v in columns.values()], strict=True))]
    return spark.createDataFrame(rows, schema)


def _fit(kind: DataType):
    name = kind.simpleString()
    if name in ("double", "float"):
        return lambda x: None if x is None else float(x)
    if name.startswith("decimal"):
        from decimal import Decimal

        return lambda x: None if x is None else Decimal(x)
    return lambda x: x


def from_schema(spark: SparkSession, schema: StructType, height: int = 0) -> DataFrame:
    """A frame of ``height`` rows of zeros (empty strings, false, 1970)."""

    def zero(kind: DataType):
        if isinstance(kind, NumericType):
            return F.lit(0).cast(kind)
        if isinstance(kind, BooleanType):
            return F.lit(False)
        if isinstance(kind, DateType):
            return F.date_from_unix_date(F.lit(0))
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return F.timestamp_micros(F.lit(0)).cast(kind)
        if isinstance(kind, DayTimeIntervalType):
            return F.make_dt_interval().cast(kind)
        return F.lit("").cast(kind)

    return spark.range(height).select(*[zero(f.dataType).alias(f.name) for f in schema.fields])


def epoch_days(c):
    """A date from days since 1970."""
    return F.date_from_unix_date(c.cast("int"))


def epoch_micros(c):
    """A timestamp without zone from microseconds since 1970."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def duration_micros(c):
    """A duration from microseconds."""
    return F.make_dt_interval(secs=(c / F.lit(1_000_000)).cast("decimal(18,6)"))
