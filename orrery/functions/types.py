"""Kinds of types, and the type that holds two others."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DayTimeIntervalType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    NumericType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def is_integer(t: DataType) -> bool:
    """Whole numbers; an unsigned 64-bit one is kept as a decimal without scale."""
    return isinstance(t, _WHOLE) or isinstance(t, DecimalType) and t.scale == 0


def is_float(t: DataType) -> bool:
    return isinstance(t, (FloatType, DoubleType))


def is_numeric(t: DataType) -> bool:
    return isinstance(t, NumericType)


def is_temporal(t: DataType) -> bool:
    return isinstance(t, (DateType, TimestampType, TimestampNTZType, DayTimeIntervalType))


def is_nested(t: DataType) -> bool:
    return isinstance(t, (ArrayType, StructType, MapType))


def can_cast(a: DataType, b: DataType) -> bool:
    """Whether values of ``a`` can be cast to ``b`` at all (single values may still fail)."""
    if a == b or isinstance(a, NullType) or isinstance(b, StringType):
        return True
    if is_nested(a) or is_nested(b):
        return False
    plain = lambda t: is_numeric(t) or isinstance(t, BooleanType)
    if isinstance(a, StringType) or plain(a) and plain(b):
        return True
    dates = (DateType, TimestampType, TimestampNTZType)
    return isinstance(a, dates) and isinstance(b, dates)


def super_type(a: DataType, b: DataType) -> DataType | None:
    """The narrowest type that both can be widened to, or null: the rules of set operations and mixed columns.

    Whole numbers widen to the larger one; with a float they become double,
    but for the two smallest with a float of 32 bits. A date and a time become
    a time; anything with a string becomes a string.
    """
    if a == b:
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(b, NullType):
        return a
    if isinstance(a, StringType) or isinstance(b, StringType):
        return None if is_nested(a) or is_nested(b) else StringType()
    if is_numeric(a) and is_numeric(b):
        if is_float(a) or is_float(b):
            narrow = (FloatType, ByteType, ShortType)
            return FloatType() if isinstance(a, narrow) and isinstance(b, narrow) else DoubleType()
        if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
            return _WHOLE[max(_WHOLE.index(type(a)), _WHOLE.index(type(b)))]()
        digits = lambda t: (t.precision - t.scale, t.scale) if isinstance(t, DecimalType) else ((3, 5, 10, 19)[_WHOLE.index(type(t))], 0)
        (i, f), (j, g) = digits(a), digits(b)
        scale = max(f, g)
        return DecimalType(min(38, max(i, j) + scale), scale)
    if isinstance(a, (DateType, TimestampNTZType)) and isinstance(b, (DateType, TimestampNTZType)):
        return TimestampNTZType()
    return None
