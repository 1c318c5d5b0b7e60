"""Column functions on literal values, nulls and odd inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import expr as E
from orrery.functions import strings as S
from orrery.functions import temporal as D
from orrery.functions import types as T
from orrery.functions.layout import spark_pattern
from orrery.operators.grouping import GroupBy


def value(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: E.int_div(E.lit(-7), 2), -3),
        (lambda: E.int_div(E.lit(1), 0), None),
        (lambda: E.mod(E.lit(-7), 3), -1),
        (lambda: E.div(E.lit(1.0), 0.0), None),
        (lambda: E.log(E.lit(0.0)), float("-inf")),
        (lambda: E.floor(E.lit(-1.5)), -2.0),
        (lambda: E.round_(E.lit(2.5)), 3.0),
        (lambda: E.round_(E.lit(-2.5)), -3.0),
        (lambda: E.is_in(E.lit(None).cast("int"), 1), None),
        (lambda: E.is_in(E.lit(1)), False),
        (lambda: E.and_(E.lit(False), E.lit(None).cast("boolean")), False),
        (lambda: E.and_(E.lit(False), E.lit(None).cast("boolean"), True), None),
        (lambda: E.or_(E.lit(True), E.lit(None).cast("boolean")), True),
        (lambda: E.when(E.lit(None).cast("boolean")).then(1).otherwise(2), 2),
        (lambda: E.when(E.lit(None).cast("boolean")).then(1).otherwise(2, "null"), None),
        (lambda: E.try_cast(E.lit("x"), "long"), None),
        (lambda: S.slice_(E.lit("hello"), -10, 3), "hel"),
        (lambda: S.slice_(E.lit("héllo"), 1, 2), "él"),
        (lambda: S.slice_(E.lit(""), 0, 2), None),
        (lambda: S.split(E.lit("a.b..c"), ".", 2), ""),
        (lambda: S.split(E.lit("a.b"), ".", 5), None),
        (lambda: S.split(E.lit("a.b"), ".", -1), None),
        (lambda: S.pad(E.lit("abcdef"), 3), "abcdef"),
        (lambda: S.pad(E.lit("ab"), 5, "both", "*"), "*ab**"),
        (lambda: S.pad(E.lit("ab"), 5, "middle"), "ab"),
        (lambda: S.zfill(E.lit("-5"), 4), "00-5"),
        (lambda: S.trim(E.lit("  \ta b ")), "a b"),
        (lambda: S.strip(E.lit("xxaxx"), "x"), "a"),
        (lambda: S.extract(E.lit("ab12"), r"(\d+)", 1), "12"),
        (lambda: S.extract(E.lit("ab"), r"(\d+)", 1), None),
        (lambda: S.extract(E.lit("ab12"), r"(\d+)", 3), None),
        (lambda: S.count_matches(E.lit("banana"), "an"), 2),
        (lambda: S.capitalize(E.lit("éCOLE du")), "École du"),
        (lambda: S.capitalize(E.lit("")), ""),
        (lambda: S.lengths(E.lit("née😀")), 4),
        (lambda: S.to_datetime(E.lit("2024-02-30"), "2006-01-02"), None),
        (lambda: S.to_datetime(E.lit("2024-02-29 01:02:03.5"), "2006-01-02 15:04:05.0"), datetime.datetime(2024, 2, 29, 1, 2, 3, 500000)),
        (lambda: D.weekday(E.lit("2024-03-17").cast("date")), 0),
        (lambda: D.iso_week(E.lit("2024-12-30").cast("date")), 1),
        (lambda: D.offset_by(E.lit("2024-01-31").cast("timestamp_ntz"), "1mo"), datetime.datetime(2024, 2, 29)),
        (lambda: D.offset_by(E.lit("2024-01-31").cast("timestamp_ntz"), "1mo", "normalize"), datetime.datetime(2024, 3, 2)),
        (lambda: D.offset_by(E.lit("2024-01-31").cast("timestamp_ntz"), "soon"), datetime.datetime(2024, 1, 31)),
        (lambda: D.truncate(E.lit("2024-06-15 14:30:00").cast("timestamp_ntz"), "1mo"), datetime.datetime(2024, 6, 1)),
        (lambda: D.truncate(E.lit("2024-06-15").cast("date"), "1y", "date"), datetime.date(2024, 1, 1)),
        (lambda: D.epoch(E.lit("1969-12-31 23:59:59").cast("timestamp_ntz"), "ms"), -1000),
        (lambda: D.total_seconds(E.lit(5_500_000), micros=True), 5.5),
        (lambda: D.time_part(E.lit(3_723_000_000_007), "nanosecond"), 7),
        (lambda: D.strftime(E.lit("2024-06-05 14:03:09").cast("timestamp_ntz"), "Jan 2, 2006 at 3:04 PM"), None),
    ],
)
def test_values(spark, make, expected):
    if expected is None and "strftime" in make.__code__.co_names:
        with pytest.raises(ValueError, match="no part of a layout"):
            make()
        return
    assert value(spark, make()) == expected


def test_strict_cast_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(spark, E.cast(E.lit("x"), "long"))


def test_layouts():
    assert spark_pattern("2006-01-02T15:04:05.000000") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    assert spark_pattern("Monday, 02 January 2006") == "EEEE, dd MMMM yyyy"
    assert spark_pattern("02.01.06") == "dd.MM.yy" and spark_pattern("yyyy/MM") == "yyyy/MM"
    with pytest.raises(ValueError):
        spark_pattern("2006 week 9")


def test_patterns_beyond_the_common_subset():
    with pytest.raises(ValueError, match="look-around"):
        S.count_matches(F.col("x"), "(?=a)")


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (2, None, None), (3, 4.0, "a"), (4, 4.0, None)], "k long, v double, s string")
    r = df.agg(
        E.sum_(F.col("k")).alias("s"), E.first(F.col("s"), "k").alias("f"), E.last(F.col("s"), "k").alias("l"), E.arg_max(F.col("v"), "k").alias("am"), E.arg_min(F.col("v"), "k").alias("an"),
        E.var(F.col("v"), 3).alias("v3"), E.quantile(F.col("v"), 0.5).alias("q"), E.quantile(F.col("v"), 2).alias("bad"), E.n_unique(F.col("v")).alias("nu"),
    ).first()
    assert tuple(r) == (10.0, "b", "a", 3, 1, None, 4.0, None, 2)


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)"])
@pytest.mark.parametrize("keys", [[], ["g"], ["g", "o dd.key"]])
def test_quantiles_of_groups_are_spread_over_tasks(spark, kind, keys):
    rows = [(None if i % 5 == 0 else i % 5, i % 2, None if i % 5 == 4 or i % 7 == 0 else (i * 7919) % 613 if i % 3 else 40) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, `o dd.key` int, v long").withColumn("v", F.col("v").cast(kind))
    exprs = lambda: [E.median(F.col("v")).alias("m"), E.sum_(F.col("v")).alias("s"), *[E.quantile(F.col("v"), p).alias(f"p{i}") for i, p in enumerate((0, 0.1, 0.25, 0.333, 0.99, 1))]]
    out, plain = GroupBy(df, keys).agg_exprs(*exprs()), df.groupBy(*[E.col(k) for k in keys]).agg(*exprs())
    assert out.schema.simpleString() == plain.schema.simpleString() and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan(out) and "median(" not in plan(out) and "percentile(" in plan(plain)
    only = GroupBy(df.filter("v < 0"), keys).agg_exprs(E.median(F.col("v")).alias("m"))
    assert [tuple(r) for r in only.collect()] == ([] if keys else [(None,)])


def test_quantiles_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", inf), ("a", -inf), ("b", nan), ("b", 1.0), ("b", 2.0), ("c", inf), ("c", inf), ("e", nan), ("f", None)], "g string, v double")
    exprs = [E.median(F.col("v")).alias("m"), E.quantile(F.col("v"), 0.75).alias("q")]
    assert sorted(map(str, GroupBy(df, ["g"]).agg_exprs(*exprs).collect())) == sorted(map(str, df.groupBy("g").agg(*exprs).collect()))


def test_lists_sorted_by_another_column(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, None, 3), (1, "n", None)], "k long, v string, o long")
    r = df.groupBy("k").agg(E.sort_by(F.col("v"), F.col("o")).alias("up"), E.sort_by(F.col("v"), F.col("o"), True).alias("down")).first()
    assert r["up"] == ["a", "b", None, "n"] and r["down"] == [None, "b", "a", "n"]


def test_types():
    from pyspark.sql.types import ArrayType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, TimestampNTZType

    assert T.super_type(ShortType(), LongType()) == LongType() and T.super_type(LongType(), FloatType()) == DoubleType() and T.super_type(ShortType(), FloatType()) == FloatType()
    assert T.super_type(DecimalType(10, 2), IntegerType()) == DecimalType(12, 2) and T.super_type(DecimalType(10, 2), FloatType()) == DoubleType()
    assert T.super_type(DateType(), TimestampNTZType()) == TimestampNTZType() and T.super_type(BooleanType(), StringType()) == StringType()
    assert T.super_type(NullType(), DateType()) == DateType() and T.super_type(BooleanType(), LongType()) is None and T.super_type(ArrayType(LongType()), StringType()) is None
    assert T.can_cast(StringType(), LongType()) and T.can_cast(DateType(), TimestampNTZType()) and not T.can_cast(DateType(), LongType()) and not T.can_cast(ArrayType(LongType()), LongType())
    assert T.is_integer(DecimalType(20, 0)) and not T.is_integer(DoubleType()) and T.is_temporal(DateType()) and T.is_nested(ArrayType(LongType())) and T.is_float(FloatType()) and T.is_numeric(LongType())
