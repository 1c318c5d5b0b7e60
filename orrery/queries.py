"""The registered queries of the engine's operators over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Frame
from .functions import expr as E
from .functions import strings as S
from .functions import temporal as D
from .functions.expr import col
from .operators import grouping, joins, relational, reshape
from .plans.sqlcontext import SQLContext
from .sources import csv, database, excel, json, memory, parquet
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(name: str, source: str, key: list[str], exprs: Callable[[], dict[str, Column]], sql: dict[str, str], where: str = "") -> None:
    """A query of some expressions over all rows of a table, beside its key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.select(table(spark, sf_dir, source), *key, *[e.alias(n) for n, e in exprs().items()])

    columns = ", ".join([*key, *[f"{x} AS {n}" for n, x in sql.items()]])
    query(f"SELECT {columns} FROM {source} {where}", name)(run)


def r4(c: Column) -> Column:
    return F.round(c, 4)


# Projection, filters, predicates

LINE = ["l_orderkey", "l_linenumber"]
L_ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2"""
)
def agg_pricing_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").filter(col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    out = df.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(E.sum_(col("l_quantity")), 4).alias("sum_qty"),
        F.round(E.sum_(col("l_extendedprice")), 2).alias("sum_base_price"),
        F.round(E.sum_(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(E.mean(col("l_discount")), 8).alias("avg_disc"),
        E.count().alias("count_order"),
    )
    return relational.sort(out, ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def proj_select(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders")).select("o_orderkey", "o_totalprice").df


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 2, 4) AS o_totalprice, o_orderdate, o_orderpriority, round(o_totalprice + 1, 4) AS plus_one FROM orders")
def proj_with_columns(spark, sf_dir):
    # Both expressions see the price as it was.
    return Frame(table(spark, sf_dir, "orders")).with_columns({"o_totalprice": r4(E.mul(col("o_totalprice"), 2)), "plus_one": r4(E.add(col("o_totalprice"), 1))}).df


@query("SELECT s_suppkey, s_name FROM supplier")
def proj_drop(spark, sf_dir):
    return Frame(table(spark, sf_dir, "supplier")).drop("s_nationkey", "s_acctbal").df


@query("SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def proj_rename(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).rename("n_nationkey", "id").df


@query("SELECT n_nationkey AS pre_n_nationkey_suf, n_name AS pre_n_name_suf, n_regionkey AS pre_n_regionkey_suf FROM nation")
def proj_name_prefix_suffix(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).rename_each(lambda c: f"pre_{c}_suf").df


@query("SELECT n_name AS N_NAME, n_nationkey AS N_NATIONKEY, n_regionkey AS N_REGIONKEY FROM nation")
def proj_name_map(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).rename_each(str.upper).df


@query("SELECT r_name, CAST(7 AS BIGINT) AS whole, CAST(2.5 AS DOUBLE) AS broken, 'x' AS literal, true AS yes FROM region")
def proj_literal_alias(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name", E.lit(7).alias("whole"), E.lit(2.5).alias("broken"), E.lit("x"), E.lit(True).alias("yes"))


@query(f"SELECT {L_ALL} FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05 OR l_tax = 0.08")
def filter_and_or(spark, sf_dir):
    q, d, t = col("l_quantity"), col("l_discount"), col("l_tax")
    return Frame(table(spark, sf_dir, "lineitem")).filter(E.or_(E.and_(E.gt(q, 45), E.le(d, 0.05)), E.eq(t, 0.08))).df


@query("SELECT * FROM customer WHERE NOT (c_acctbal < 0) AND c_mktsegment <> 'BUILDING' AND c_name IS NOT NULL")
def filter_not(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.filter(E.not_(E.lt(col("c_acctbal"), 0)) & E.ne(col("c_mktsegment"), "BUILDING") & E.is_not_null(col("c_name")))


@query("SELECT * FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500")
def filter_in_between(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(E.is_in(col("p_size"), 1, 5, 9) & E.is_between(col("p_retailprice"), 900, 1500))


def _maybe():
    return F.when(col("l_linenumber") > 1, col("l_linenumber").cast("long"))


def _flag():
    return F.when(col("l_linenumber") != 2, col("l_quantity") > 25)


def _other():
    return F.when(col("l_linenumber") != 3, col("l_discount") > 0.05)


_M = "CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS BIGINT) END"
_FL, _OT = "CASE WHEN l_linenumber <> 2 THEN l_quantity > 25 END", "CASE WHEN l_linenumber <> 3 THEN l_discount > 0.05 END"

each("pred_compare", "lineitem", LINE, lambda: {"eq": E.eq(_maybe(), 2), "ne": E.ne(_maybe(), 2), "lt": E.lt(_maybe(), 3), "gt": E.gt(_maybe(), 3), "le": E.le(_maybe(), 3), "ge": E.ge(_maybe(), 3)}, {"eq": f"{_M} = 2", "ne": f"{_M} <> 2", "lt": f"{_M} < 3", "gt": f"{_M} > 3", "le": f"{_M} <= 3", "ge": f"{_M} >= 3"})
each("pred_logic", "lineitem", LINE, lambda: {"a": E.and_(_flag(), _other()), "o": E.or_(_flag(), _other()), "n": E.not_(_flag())}, {"a": f"({_FL}) AND ({_OT})", "o": f"({_FL}) OR ({_OT})", "n": f"NOT ({_FL})"})
each("pred_logic_null_dominant", "lineitem", LINE, lambda: {"a": E.and_(_flag(), _other(), True), "o": E.or_(_flag(), _other(), True)}, {k: f"CASE WHEN ({_FL}) IS NULL OR ({_OT}) IS NULL THEN NULL ELSE ({_FL}) {op} ({_OT}) END" for k, op in (("a", "AND"), ("o", "OR"))})
each("pred_null", "lineitem", LINE, lambda: {"is_null": E.is_null(_maybe()), "is_not_null": E.is_not_null(_maybe())}, {"is_null": f"({_M}) IS NULL", "is_not_null": f"({_M}) IS NOT NULL"})
each("pred_is_in", "lineitem", LINE, lambda: {"found": E.is_in(_maybe(), 2, 4), "between": E.is_between(_maybe(), 2, 3)}, {"found": f"({_M}) IN (2, 4)", "between": f"({_M}) BETWEEN 2 AND 3"})
each(
    "expr_when",
    "lineitem",
    LINE,
    lambda: {
        "size": E.when(E.gt(col("l_quantity"), 40)).then("large").when(E.gt(col("l_quantity"), 20)).then("middle").otherwise("small"),
        "no_else": E.when(E.gt(col("l_quantity"), 40)).then(col("l_quantity")).end(),
        "null_condition": E.when(_flag()).then("yes").otherwise("no", null_condition="null"),
    },
    {
        "size": "CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END",
        "no_else": "CASE WHEN l_quantity > 40 THEN l_quantity END",
        "null_condition": f"CASE WHEN ({_FL}) IS NULL THEN NULL WHEN ({_FL}) THEN 'yes' ELSE 'no' END",
    },
)

# Arithmetic, mathematics, casts, nulls

def _p():
    return col("l_extendedprice")


def _q():
    return col("l_quantity")


def _k():
    return col("l_orderkey") - 1000


each("expr_arithmetic", "lineitem", LINE, lambda: {"a": E.add(_p(), _q()), "s": E.sub(_p(), _q()), "m": E.mul(_p(), _q()), "d": E.div(_p(), _q()), "n": E.neg(_p())}, {"a": "l_extendedprice + l_quantity", "s": "l_extendedprice - l_quantity", "m": "l_extendedprice * l_quantity", "d": "l_extendedprice / l_quantity", "n": "-l_extendedprice"})
each("expr_int_div_mod", "lineitem", LINE, lambda: {"d": E.int_div(_k(), 7), "m": E.mod(_k(), 7), "z": E.int_div(_k(), 0)}, {"d": "CAST(trunc((l_orderkey - 1000) / 7) AS BIGINT)", "m": "(l_orderkey - 1000) % 7", "z": "CAST(NULL AS BIGINT)"})
each("expr_pow", "lineitem", LINE, lambda: {"p": r4(E.power(col("l_discount") + 1, 3)), "e": r4(E.exp(col("l_tax"))), "s": r4(E.sqrt(_p())), "a": r4(E.abs_(_q() - 25))}, {"p": "round(pow(l_discount + 1, 3), 4)", "e": "round(exp(l_tax), 4)", "s": "round(sqrt(l_extendedprice), 4)", "a": "round(abs(l_quantity - 25), 4)"})
each("expr_log", "lineitem", LINE, lambda: {"l": r4(E.log(_p())), "zero": E.log(_p() * 0).cast("string"), "below": E.log(-_p()).cast("string")}, {"l": "round(ln(l_extendedprice), 4)", "zero": "'-Infinity'", "below": "'NaN'"})
each("expr_floor_ceil_round", "lineitem", LINE, lambda: {"f": E.floor(_p()), "c": E.ceil(_p()), "r": E.round_(_p(), 1), "t": E.round_(col("l_orderkey"), -2)}, {"f": "floor(l_extendedprice)", "c": "ceil(l_extendedprice)", "r": "round(l_extendedprice, 1)", "t": "CAST(round(CAST(l_orderkey AS DOUBLE), -2) AS BIGINT)"})
each("expr_cast", "lineitem", LINE, lambda: {"i": E.cast(_q(), "long"), "d": E.cast(col("l_orderkey"), "double"), "s": E.cast(col("l_orderkey"), "string"), "b": E.cast(_q() > 25, "int")}, {"i": "CAST(trunc(l_quantity) AS BIGINT)", "d": "CAST(l_orderkey AS DOUBLE)", "s": "CAST(l_orderkey AS VARCHAR)", "b": "CAST(l_quantity > 25 AS INTEGER)"})
each("expr_try_cast", "orders", ["o_orderkey"], lambda: {"i": E.try_cast(F.substring(col("o_orderpriority"), 1, 1), "long"), "bad": E.try_cast(col("o_orderpriority"), "double")}, {"i": "TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT)", "bad": "TRY_CAST(o_orderpriority AS DOUBLE)"})
each("expr_fill_null", "lineitem", LINE, lambda: {"v": E.fill_null(_maybe(), -1), "w": E.fill_null(_maybe(), col("l_orderkey"))}, {"v": f"coalesce({_M}, -1)", "w": f"coalesce({_M}, l_orderkey)"})


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE, _maybe().alias("a"), F.when(col("l_quantity") > 10, col("l_quantity")).alias("b"), F.when(col("l_tax") > 0.02, col("l_returnflag")).alias("c"))


_HOLES = f"(SELECT l_orderkey, l_linenumber, {_M} AS a, CASE WHEN l_quantity > 10 THEN l_quantity END AS b, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS c FROM lineitem)"


@query(f"SELECT * FROM {_HOLES} WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def null_drop(spark, sf_dir):
    return Frame(_holes(spark, sf_dir)).drop_nulls().df


@query(f"SELECT l_orderkey, l_linenumber, coalesce(a, 0) AS a, coalesce(b, -1.5) AS b, coalesce(c, 'none') AS c FROM {_HOLES}")
def null_fill(spark, sf_dir):
    return Frame(_holes(spark, sf_dir)).fill_null({"a": 0, "b": -1.5, "c": "none"}).df


@query(f"SELECT count(*) FILTER (a IS NULL) AS a, count(*) FILTER (b IS NULL) AS b, count(*) FILTER (c IS NULL) AS c FROM {_HOLES}")
def null_count(spark, sf_dir):
    return grouping.null_counts(_holes(spark, sf_dir).select("a", "b", "c"))


# Aggregation


@query(
    """SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(avg(l_extendedprice), 6) AS m, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    count(l_tax) AS n, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va, median(l_extendedprice) AS med,
    quantile_cont(l_extendedprice, 0.25) AS q25, count(DISTINCT l_suppkey) AS nu FROM lineitem GROUP BY ALL"""
)
def agg_exprs(spark, sf_dir):
    q, p = col("l_quantity"), col("l_extendedprice")
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag").agg_exprs(
        r4(E.sum_(q)).alias("s"), F.round(E.mean(p), 6).alias("m"), E.min_(p).alias("lo"), E.max_(p).alias("hi"), E.count(col("l_tax")).alias("n"),
        F.round(E.std(q), 6).alias("sd"), F.round(E.var(q), 6).alias("va"), E.median(p).alias("med"), E.quantile(p, 0.25).alias("q25"), E.n_unique(col("l_suppkey")).alias("nu"),
    )


@query("SELECT round(stddev_pop(l_quantity), 6) AS sd0, round(var_pop(l_quantity), 6) AS v0, round(var_pop(l_quantity) * count(*) / (count(*) - 2), 6) AS v2, CAST(sum(l_orderkey) AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS q FROM lineitem")
def agg_whole_ddof(spark, sf_dir):
    q = col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(F.round(E.std(q, 0), 6).alias("sd0"), F.round(E.var(q, 0), 6).alias("v0"), F.round(E.var(q, 2), 6).alias("v2"), E.sum_(col("l_orderkey")).alias("s"), E.quantile(q, 1.5).alias("q"))


@query(
    """SELECT o_custkey, CAST(sum(o_orderkey) AS DOUBLE) AS o_orderkey, max(o_orderdate) AS o_orderdate, round(avg(o_totalprice), 6) AS o_totalprice,
    count(o_orderpriority) AS o_orderpriority FROM orders GROUP BY ALL"""
)
def agg_map(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "orders")).group_by("o_custkey").agg({"o_orderkey": "sum", "o_orderdate": "max", "o_totalprice": "mean", "o_orderpriority": "count"})
    return out.withColumn("o_totalprice", F.round(col("o_totalprice"), 6))


@query(
    """SELECT o_custkey, arg_min(p, o_orderkey) AS f, arg_max(p, o_orderkey) AS l, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest,
    arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest
    FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS p FROM orders) GROUP BY ALL"""
)
def agg_first_last_arg(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("p", F.when(col("o_orderstatus") != "F", col("o_orderpriority")))
    return df.groupBy("o_custkey").agg(
        E.first(col("p"), "o_orderkey").alias("f"), E.last(col("p"), "o_orderkey").alias("l"), E.arg_min(col("o_totalprice"), "o_orderkey").alias("cheapest"), E.arg_max(col("o_totalprice"), "o_orderkey").alias("dearest")
    )


@query("SELECT g, count(*) AS n FROM (SELECT CASE WHEN l_linenumber > 1 THEN l_linenumber END AS g FROM lineitem) GROUP BY g")
def agg_null_key(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.when(col("l_linenumber") > 1, col("l_linenumber")).alias("g"))
    return Frame(df).group_by("g").agg_exprs(E.count().alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL")
def agg_multi_key(spark, sf_dir):
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus", "l_linenumber").agg_exprs(E.count().alias("n"), E.min_(col("l_shipdate"), keep_type=True).alias("first_ship"))


@query("SELECT l_orderkey, round(sum(l_quantity), 4) AS s, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_many_groups(spark, sf_dir):
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_orderkey").agg_exprs(r4(E.sum_(col("l_quantity"))).alias("s"), E.count().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf_dir):
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").rollup(E.count().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return Frame(table(spark, sf_dir, "lineitem")).group_by("l_returnflag", "l_linestatus").cube(E.count().alias("n"))


_STATS = {"count": "count({})", "mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "max": "max({})"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS statistic, {', '.join(f'round(CAST({x.format(c)} AS DOUBLE), 4) AS {c}' for c in ('p_partkey', 'p_size', 'p_retailprice'))} FROM part" for k, x in _STATS.items()))
def agg_describe(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "part")).describe().df
    return out.select("statistic", *[r4(col(c)).alias(c) for c in ("p_partkey", "p_size", "p_retailprice")])


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL")
def agg_user_function(spark, sf_dir):
    def p90(pdf):
        import pandas as pd

        return pd.DataFrame({"l_suppkey": [pdf["l_suppkey"].iloc[0]], "p90": [pdf["l_extendedprice"].quantile(0.9)]})

    out = Frame(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")).group_by("l_suppkey").apply(p90, "l_suppkey long, p90 double")
    return out.withColumn("p90", r4(col("p90")))


# Windows and row order; events by user, in the order of time

EV = ["event_id", "user_id"]
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _v():
    return col("value")


def _h():
    return F.when(col("event_id") % 5 != 0, col("value"))


_H = "CASE WHEN event_id % 5 <> 0 THEN value END"


def ordered(name: str, exprs: Callable[[], dict[str, E.Ordered]], sql: dict[str, str], partition: tuple[str, ...] = ("user_id",)) -> None:
    """A query of expressions that depend on the row order, of each user's events or (without partition) of all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = Frame(table(spark, sf_dir, "events"), ["ts", "event_id"]).with_columns({n: e.over(*partition) for n, e in exprs().items()})
        return frame.df.select(*EV, *[F.round(col(n), 4).alias(n) if frame.df.schema[n].dataType.simpleString() == "double" else col(n) for n in sql])

    text = ", ".join(f"{x if partition else x.replace('PARTITION BY user_id ', '')} AS {n}" for n, x in sql.items())
    query(f"SELECT event_id, user_id, {text} FROM (SELECT *, {_H} AS h FROM events)", name)(run)


def _run(f: str) -> str:
    return f"round(CASE WHEN h IS NOT NULL THEN {f}(h) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END, 4)"


def _roll(f: str, c: str = "value", n: int = 3) -> str:
    over = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({c}) {over} = {n} THEN {f}({c}) {over} END, 4)"


_shifts = lambda: {"lag1": E.shift(_v(), 1), "lead2": E.shift(_v(), -2), "d": E.diff(_v(), 1), "d2": E.diff(_v(), 2), "p": E.pct_change(_v(), 1)}
_SHIFTS = {
    "lag1": f"round(lag(value, 1) OVER {W}, 4)",
    "lead2": f"round(lead(value, 2) OVER {W}, 4)",
    "d": f"round(value - lag(value, 1) OVER {W}, 4)",
    "d2": f"round(value - lag(value, 2) OVER {W}, 4)",
    "p": f"round(CASE WHEN lag(value) OVER {W} <> 0 THEN (value - lag(value) OVER {W}) / lag(value) OVER {W} END, 4)",
}
_cums = lambda: {"cs": E.cum_sum(_h()), "lo": E.cum_min(_h()), "hi": E.cum_max(_h())}
_CUMS = {"cs": _run("sum"), "lo": _run("min"), "hi": _run("max")}
_rolls = lambda: {"s": E.rolling_sum(_v(), 3), "m": E.rolling_mean(_v(), 3), "lo": E.rolling_min(_v(), 3), "hi": E.rolling_max(_v(), 3), "sd": E.rolling_std(_v(), 3), "holes": E.rolling_sum(_h(), 3)}
_ROLLS = {"s": _roll("sum"), "m": _roll("avg"), "lo": _roll("min"), "hi": _roll("max"), "sd": _roll("stddev_samp"), "holes": _roll("sum", "h")}
_ranks = lambda: {m: E.rank(F.floor(_h() / 10), m) for m in ("average", "min", "max", "dense", "ordinal")}
_G = "floor(h / 10)"
_LEAST, _SAME = f"rank() OVER (PARTITION BY user_id ORDER BY {_G} NULLS LAST)", f"count(*) OVER (PARTITION BY user_id , {_G})"
_RANKS = {
    m: f"CASE WHEN h IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    for m, x in {
        "average": f"{_LEAST} + ({_SAME} - 1) / 2",
        "min": _LEAST,
        "max": f"{_LEAST} + {_SAME} - 1",
        "dense": f"dense_rank() OVER (PARTITION BY user_id ORDER BY {_G} NULLS LAST)",
        "ordinal": f"row_number() OVER (PARTITION BY user_id ORDER BY {_G} NULLS LAST, ts, event_id)",
    }.items()
}
_fills = lambda: {"pad": E.interpolate(_h(), "pad"), "ff": E.interpolate(_h(), "ffill"), "bf": E.interpolate(_h(), "bfill")}
_FF = "round(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4)"
_BF = "round(first_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4)"
_FILLS = {"pad": _FF, "ff": _FF, "bf": _BF}

ordered("win_shift_diff", _shifts, _SHIFTS)
ordered("win_cumulative", _cums, _CUMS)
ordered("win_rolling", _rolls, _ROLLS)
ordered("win_rank", _ranks, _RANKS)
ordered("win_fill", _fills, _FILLS)
# The same over all events, spread over chunks of rows.
ordered("win_shift_diff_whole", _shifts, _SHIFTS, ())
ordered("win_cumulative_whole", _cums, _CUMS, ())
ordered("win_rolling_whole", _rolls, _ROLLS, ())
ordered("win_rank_whole", _ranks, {n: x.replace("PARTITION BY user_id ,", "PARTITION BY") for n, x in _RANKS.items()}, ())
ordered("win_fill_whole", _fills, _FILLS, ())

_LINEAR = f"""
SELECT event_id, user_id, round(CASE WHEN h IS NOT NULL THEN h ELSE y0 + (y1 - y0) * (rn - x0) / (x1 - x0) END, 4) AS lin FROM (
  SELECT *, last_value(h IGNORE NULLS) OVER a AS y0, last_value(k IGNORE NULLS) OVER a AS x0, first_value(h IGNORE NULLS) OVER b AS y1, first_value(k IGNORE NULLS) OVER b AS x1
  FROM (SELECT *, CASE WHEN h IS NOT NULL THEN rn END AS k FROM (SELECT *, {_H} AS h, CAST(row_number() OVER {W} AS DOUBLE) AS rn FROM events))
  WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(_LINEAR)
def win_interpolate(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "events"), ["ts", "event_id"]).with_column("lin", E.interpolate(_h()).over("user_id"))
    return out.df.select(*EV, r4(col("lin")).alias("lin"))


@query(_LINEAR.replace("PARTITION BY user_id ", ""))
def win_interpolate_whole(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "events"), ["ts", "event_id"]).with_column("lin", E.interpolate(_h()))
    return out.df.select(*EV, r4(col("lin")).alias("lin"))


@query("SELECT o_orderkey, round(exp(sum(ln(1.001)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)), 6) AS cp FROM orders")
def win_cum_prod(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "orders").withColumn("f", F.lit(1.001)), "o_orderkey").with_column("cp", E.cum_prod(col("f")).over("o_custkey"))
    return out.df.select("o_orderkey", F.round("cp", 6).alias("cp"))


@query(
    """SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 4) AS s, round(avg(l_extendedprice) OVER w, 6) AS m, min(l_extendedprice) OVER w AS lo,
    max(l_extendedprice) OVER w AS hi, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)"""
)
def win_over(spark, sf_dir):
    by = "l_suppkey"
    return table(spark, sf_dir, "lineitem").select(
        *LINE, r4(E.over("sum", by, of=_q())).alias("s"), F.round(E.over("mean", by, of=_p()), 6).alias("m"), E.over("min", by, of=_p()).alias("lo"), E.over("max", by, of=_p()).alias("hi"), E.over(E.count(), by).alias("n")
    )


@query("SELECT l_orderkey, l_linenumber, (SELECT count(DISTINCT m.l_suppkey) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) AS nu FROM lineitem l")
def win_n_unique_over(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE, E.n_unique_over(col("l_suppkey"), "l_orderkey").alias("nu"))


# Sort, limit, selection


@query("SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def sort_one(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer"), "c_custkey").sort("c_acctbal", True).df


@query("SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey")
def sort_multi(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer"), "c_custkey").sort(["c_mktsegment", "c_acctbal"], [False, True]).df


@query("SELECT c_custkey - 1 AS idx, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS c_custkey, c_acctbal FROM customer)")
def sort_arg(spark, sf_dir):
    return relational.arg_sort(table(spark, sf_dir, "customer"), "c_acctbal", ["c_custkey"])


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
def select_head(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").head(25).df


@query("SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 25) ORDER BY o_orderkey")
def select_tail(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").tail(25).df


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10")
def select_slice(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").slice(10, 50).df


@query("WITH p(pos, idx) AS (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) SELECT n_nationkey, n_name, n_regionkey FROM p JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) ON rn = idx ORDER BY pos")
def select_gather(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation"), "n_nationkey").gather([7, 3, 7, 0]).df


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def select_top_k(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").top_k("o_totalprice", 10).df


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def select_top_k_per_group(spark, sf_dir):
    return relational.top_k_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 2, ["o_orderkey"])


@query()
def select_sample(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders")).sample(100, seed=3).df


@query()
def select_sample_fraction(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders")).sample_fraction(0.1, seed=3).df


# Distinct, sets, concatenation


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_rows(spark, sf_dir):
    return relational.unique(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def unique_first(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").unique("o_custkey", "o_orderstatus").df


@query("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY min(c_custkey)")
def unique_values(spark, sf_dir):
    return Frame(table(spark, sf_dir, "customer"), "c_custkey").unique_values("c_mktsegment").df


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) > 1 AS is_duplicated FROM lineitem")
def unique_is_duplicated(spark, sf_dir):
    return relational.is_duplicated(table(spark, sf_dir, "lineitem"), "l_partkey").select(*LINE, "is_duplicated")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def concat_vertical(spark, sf_dir):
    n = Frame(table(spark, sf_dir, "nation"))
    return n.concat(n.filter(col("n_regionkey") == 1)).df


@query("SELECT c_custkey, c_name, k, a FROM customer JOIN (SELECT c_custkey AS k, c_acctbal AS a FROM customer) ON c_custkey = k")
def concat_horizontal(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    left, right = c.select("c_custkey", "c_name"), c.select(col("c_custkey").alias("k"), col("c_acctbal").alias("a"))
    return Frame(left, "c_custkey").concat_horizontal(Frame(right, "k")).df


_A, _B = "SELECT n_nationkey % 8 AS k FROM nation", "SELECT r_regionkey * 2 AS k FROM region"


def _two(spark, sf_dir):
    return table(spark, sf_dir, "nation").select((col("n_nationkey") % 8).alias("k")), table(spark, sf_dir, "region").select((col("r_regionkey") * 2).alias("k"))


@query(f"{_A} UNION {_B}")
def set_union(spark, sf_dir):
    return relational.union_distinct(*_two(spark, sf_dir))


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf_dir):
    return relational.intersect(*_two(spark, sf_dir))


@query(f"{_B} EXCEPT {_A}")
def set_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return relational.except_(b, a)


# Joins of whole tables; some keys are null, which match, and some have no partner

_KEY = "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN -o_custkey ELSE o_custkey END"
_OC = f"(SELECT o_orderkey, {_KEY} AS k, o_totalprice AS v FROM orders)"
_CU = "(SELECT nullif(c_custkey, 11) AS k, c_name, c_acctbal AS v FROM customer)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_KEY).alias("k"), col("o_totalprice").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.expr("nullif(c_custkey, 11L)").alias("k"), "c_name", col("c_acctbal").alias("v"))
    return o, c


for _how, _sql in {
    "inner": "SELECT o_orderkey, a.k, a.v, c_name, b.v AS v_right FROM {a} a JOIN {b} b ON a.k IS NOT DISTINCT FROM b.k",
    "left": "SELECT o_orderkey, a.k, a.v, c_name, b.v AS v_right FROM {a} a LEFT JOIN {b} b ON a.k IS NOT DISTINCT FROM b.k",
    "right": "SELECT o_orderkey, coalesce(a.k, b.k) AS k, a.v, c_name, b.v AS v_right FROM {a} a RIGHT JOIN {b} b ON a.k IS NOT DISTINCT FROM b.k",
    "full": "SELECT o_orderkey, coalesce(a.k, b.k) AS k, a.v, c_name, b.v AS v_right FROM {a} a FULL JOIN {b} b ON a.k IS NOT DISTINCT FROM b.k",
    "semi": "SELECT * FROM {a} a WHERE EXISTS (SELECT 1 FROM {b} b WHERE a.k IS NOT DISTINCT FROM b.k)",
    "anti": "SELECT * FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE a.k IS NOT DISTINCT FROM b.k)",
}.items():

    def _join(spark, sf_dir, how=_how):
        a, b = _sides(spark, sf_dir)
        return Frame(a).join(Frame(b), "k", how).df

    query(_sql.format(a=_OC, b=_CU), f"join_{_how}")(_join)


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).join(Frame(table(spark, sf_dir, "region")), how="cross").df


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_different_keys(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation")).join(Frame(table(spark, sf_dir, "region")), how="inner", left_on="n_regionkey", right_on="r_regionkey").df


@query("SELECT s.l_orderkey, s.l_linenumber, t.l_quantity, t.l_tax AS t FROM lineitem s JOIN lineitem t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber")
def join_multi_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return joins.join(li.select(*LINE), li.select(*LINE, "l_quantity", col("l_tax").alias("t")), LINE)


@query(f"SELECT o_orderkey, a.k, a.v, c_name, b.v AS v_right FROM {_OC} a JOIN {_CU} b ON a.k = b.k")
def join_sql_nulls(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return joins.join(a, b, "k", null_equal=False)


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_salted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.salted_join(o, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])


# Reshape


@query(
    """SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O,
    arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey"""
)
def reshape_pivot(spark, sf_dir):
    return Frame(table(spark, sf_dir, "orders"), "o_orderkey").pivot("o_custkey", "o_orderstatus", "o_totalprice").df


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def reshape_unpivot(spark, sf_dir):
    return Frame(table(spark, sf_dir, "part")).unpivot(["p_partkey"], ["p_size", "p_retailprice"]).df


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"max(CAST({c} AS DOUBLE)) FILTER (rn = {i + 1}) AS column_{i}" for i in range(25)) + " FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation)"
        for c in ("n_nationkey", "n_regionkey")
    )
)
def reshape_transpose(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", col("n_nationkey").alias("o"))
    return Frame(df, "o").transpose().df


@query("SELECT p_partkey, trim(x) AS words FROM (SELECT p_partkey, unnest(string_split(replace(p_type, ' ', ' , '), ',')) AS x FROM part)")
def reshape_explode(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", S.replace(col("p_type"), " ", " , ").alias("words"))
    return Frame(df).explode("words").df


# Strings


def _n():
    return col("p_name")


each("str_search", "part", ["p_partkey"], lambda: {"c": S.contains(_n(), "re"), "s": S.starts_with(_n(), "b"), "e": S.ends_with(_n(), "d")}, {"c": "contains(p_name, 're')", "s": "starts_with(p_name, 'b')", "e": "ends_with(p_name, 'd')"})
each("str_case", "part", ["p_partkey"], lambda: {"u": S.to_upper(_n()), "l": S.to_lower(col("p_brand")), "cap": S.capitalize(col("p_type"))}, {"u": "upper(p_name)", "l": "lower(p_brand)", "cap": "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"})
each("str_replace_trim", "part", ["p_partkey"], lambda: {"r": S.replace(_n(), "e", "__"), "t": S.trim(F.concat(F.lit(" \t"), _n(), F.lit("\n "))), "s": S.strip(F.concat(F.lit("xyx"), _n(), F.lit("yy")), "xy")}, {"r": "replace(p_name, 'e', '__')", "t": "trim(p_name, ' \t\n')", "s": "trim('xyx' || p_name || 'yy', 'xy')"})
each("str_lengths", "documents", ["doc_id"], lambda: {"n": S.lengths(col("text"))}, {"n": "CAST(length(text) AS BIGINT)"})
each("str_split", "part", ["p_partkey"], lambda: {"a": S.split(col("p_type"), " ", 0), "b": S.split(col("p_type"), " ", 9)}, {"a": "string_split(p_type, ' ')[1]", "b": "string_split(p_type, ' ')[10]"})
each(
    "str_slice",
    "part",
    ["p_partkey"],
    lambda: {"a": S.slice_(_n(), 1, 3), "b": S.slice_(_n(), -4, 2), "c": S.slice_(_n(), 1000, 2)},
    {"a": "CASE WHEN length(p_name) > 1 THEN substr(p_name, 2, 3) END", "b": "substr(p_name, greatest(length(p_name) - 4, 0) + 1, 2)", "c": "CAST(NULL AS VARCHAR)"},
)
_PAD = "repeat('*', CAST(greatest(30 - length(p_name), 0) AS BIGINT))"
each(
    "str_pad",
    "part",
    ["p_partkey"],
    lambda: {"l": S.pad(_n(), 30, "left", "*"), "r": S.pad(_n(), 30, "right", "*"), "b": S.pad(_n(), 30, "both", "*"), "z": S.zfill(F.col("p_size").cast("string"), 5)},
    {
        "l": f"{_PAD} || p_name",
        "r": f"p_name || {_PAD}",
        "b": "repeat('*', CAST(floor(greatest(30 - length(p_name), 0) / 2) AS BIGINT)) || p_name || repeat('*', CAST(ceil(greatest(30 - length(p_name), 0) / 2) AS BIGINT))",
        "z": "lpad(CAST(p_size AS VARCHAR), 5, '0')",
    },
)
each("str_regex", "part", ["p_partkey"], lambda: {"x": S.extract(col("p_brand"), r"#(\d)(\d)", 2), "no": S.extract(col("p_brand"), r"(zzz)", 1), "n": S.count_matches(_n(), "[aeiou]")}, {"x": r"CASE WHEN regexp_matches(p_brand, '#(\d)(\d)') THEN regexp_extract(p_brand, '#(\d)(\d)', 2) END", "no": "CAST(NULL AS VARCHAR)", "n": "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT)"})
each("str_to_datetime", "orders", ["o_orderkey"], lambda: {"t": S.to_datetime(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"), "02/01/2006 15:04:05"), "bad": S.to_datetime(col("o_orderpriority"), "2006-01-02")}, {"t": "o_orderdate", "bad": "CAST(NULL AS TIMESTAMP)"})

# Times


def _t():
    return col("ts")


each(
    "dt_parts",
    "events",
    ["event_id"],
    lambda: {"y": D.year(_t()), "mo": D.month(_t()), "d": D.day(_t()), "h": D.hour(_t()), "mi": D.minute(_t()), "s": D.second(_t()), "ns": D.nanosecond(_t()), "wd": D.weekday(_t()), "wk": D.iso_week(_t()), "dy": D.day_of_year(_t()), "q": D.quarter(_t())},
    {
        "y": "CAST(year(ts) AS INTEGER)", "mo": "CAST(month(ts) AS INTEGER)", "d": "CAST(day(ts) AS INTEGER)", "h": "CAST(hour(ts) AS INTEGER)", "mi": "CAST(minute(ts) AS INTEGER)", "s": "CAST(second(ts) AS INTEGER)",
        "ns": "CAST((epoch_us(ts) % 1000000) * 1000 AS INTEGER)", "wd": "CAST(dayofweek(ts) AS INTEGER)", "wk": "CAST(weekofyear(ts) AS INTEGER)", "dy": "CAST(dayofyear(ts) AS INTEGER)", "q": "CAST(quarter(ts) AS INTEGER)",
    },
)
each("dt_truncate", "events", ["event_id"], lambda: {"h": D.truncate(_t(), "1h"), "d": D.truncate(_t(), "1d"), "m": D.truncate(_t(), "1mo"), "y": D.truncate(_t(), "1y"), "x": D.truncate(_t(), "3x")}, {"h": "CAST(date_trunc('hour', ts) AS TIMESTAMP)", "d": "CAST(date_trunc('day', ts) AS TIMESTAMP)", "m": "CAST(date_trunc('month', ts) AS TIMESTAMP)", "y": "CAST(date_trunc('year', ts) AS TIMESTAMP)", "x": "ts"})
each("dt_strftime", "events", ["event_id"], lambda: {"a": D.strftime(_t(), "2006-01-02 15:04:05"), "b": D.strftime(_t(), "02.01.06")}, {"a": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "b": "strftime(ts, '%d.%m.%y')"})
each(
    "dt_offset_by",
    "orders",
    ["o_orderkey"],
    lambda: {k: D.offset_by(col("o_orderdate"), k2) for k, k2 in {"d": "7d", "mo": "2mo", "y": "-1y", "h": "3h", "m": "5m", "s": "-10s"}.items()},
    {k: f"o_orderdate + INTERVAL ({n}) {u}" for k, n, u in (("d", 7, "DAY"), ("mo", 2, "MONTH"), ("y", -1, "YEAR"), ("h", 3, "HOUR"), ("m", 5, "MINUTE"), ("s", -10, "SECOND"))},
)
each("dt_epoch", "events", ["event_id"], lambda: {"s": D.epoch(_t(), "s"), "ms": D.epoch(_t(), "ms"), "us": D.epoch(_t(), "us"), "ns": D.epoch(_t(), "ns")}, {"s": "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)", "ms": "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)", "us": "epoch_us(ts)", "ns": "epoch_us(ts) * 1000"})
each("dt_total_seconds", "orders", ["o_orderkey"], lambda: {"a": D.total_seconds(col("o_orderdate") - F.lit("1990-01-01").cast("timestamp_ntz")), "b": D.total_seconds(col("o_orderkey"), micros=True)}, {"a": "epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01')", "b": "o_orderkey / 1e6"})
each("dt_time_of_day", "events", ["event_id"], lambda: {p: D.time_part(F.col("event_id") * 7_919_000_123, p) for p in ("hour", "minute", "second", "nanosecond")}, {"hour": "CAST(event_id * 7919000123 // 3600000000000 % 24 AS INTEGER)", "minute": "CAST(event_id * 7919000123 // 60000000000 % 60 AS INTEGER)", "second": "CAST(event_id * 7919000123 // 1000000000 % 60 AS INTEGER)", "nanosecond": "CAST(event_id * 7919000123 % 1000000000 AS INTEGER)"})

# User functions


@query("SELECT o_orderkey, round(o_totalprice * 2 + o_custkey, 4) AS x FROM orders")
def udf_map_rows(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).map_rows("x", lambda r: r["o_totalprice"] * 2 + r["o_custkey"], "double")
    return out.df.select("o_orderkey", r4(col("x")).alias("x"))


@query("SELECT o_orderkey, round(o_totalprice * 2 + o_custkey, 4) AS x FROM orders")
def udf_map_batches(spark, sf_dir):
    out = Frame(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).map_batches("x", lambda a, b: a * 2 + b, "double", "o_totalprice", "o_custkey")
    return out.df.select("o_orderkey", r4(col("x")).alias("x"))


# Sources and sinks, by a round trip


def scratch(spark: SparkSession) -> str:
    """A new path in the warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch/{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def io_csv(spark, sf_dir):
    path = scratch(spark)
    csv.write_csv(table(spark, sf_dir, "supplier"), path)
    return csv.read_csv(spark, path)


@query("SELECT p_partkey AS column_0, p_name AS column_1, p_type AS column_2 FROM part")
def io_csv_options(spark, sf_dir):
    path = scratch(spark)
    csv.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), path, sep="|", header=False, quote_all=True, single=True)
    return csv.read_csv(spark, path, sep="|", header=False, dtypes={"column_0": "bigint"})


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_json(spark, sf_dir):
    path = scratch(spark)
    json.write_json(table(spark, sf_dir, "customer"), path)
    return json.read_json(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders")
def io_ndjson(spark, sf_dir):
    path = scratch(spark)
    json.write_ndjson(table(spark, sf_dir, "orders"), path)
    return json.read_ndjson(spark, path)


@query(f"SELECT {L_ALL} FROM lineitem")
def io_parquet(spark, sf_dir):
    path = scratch(spark)
    parquet.write_parquet(table(spark, sf_dir, "lineitem"), path, "zstd", ["l_returnflag"])
    return parquet.read_parquet(spark, path, L_ALL.split(", "))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def io_excel(spark, sf_dir):
    path = scratch(spark)
    excel.write_excel(table(spark, sf_dir, "supplier"), path)
    return excel.read_excel(spark, path)


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey / 2 END AS half FROM nation")
def io_database(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey / 2 END").collect()]

    def connect():
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE nation (id INTEGER, name TEXT, half REAL)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
        return db

    out = database.read_sql(spark, connect, "SELECT * FROM nation WHERE id >= ?", (0,))
    return out.withColumn("id", col("id").cast("int"))


@query("SELECT CAST(k AS BIGINT) AS k, CAST(v AS DOUBLE) AS v FROM (VALUES (1, 1.5), (2, NULL), (3, 4.0)) t(k, v)")
def io_memory(spark, sf_dir):
    return Frame.create(spark, {"k": ("int64", [1, 2, 3]), "v": ("float64", [1.5, None, 4])}).df


@query("SELECT CAST(0 AS BIGINT) AS n_nationkey, '' AS n_name FROM range(4)")
def io_zeros(spark, sf_dir):
    schema = table(spark, sf_dir, "nation").select(col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").schema
    return memory.from_schema(spark, schema, 4)


# SQL


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """The same text in the engine's SQL context and in the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = SQLContext(spark)
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            context.register(t, table(spark, sf_dir, t))
        return context.execute(text)

    query(oracle or text, name)(run)


sql("sql_select_where", "SELECT c_custkey AS id, c_name, c.c_acctbal FROM customer c WHERE (c_acctbal > 1000 AND c_mktsegment = 'BUILDING') OR c_nationkey = 3;")
sql("sql_join", "SELECT n_name, r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey")
sql("sql_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
sql("sql_right_full_cross", "SELECT count(*) AS n FROM (SELECT r_name FROM nation RIGHT JOIN region ON n_nationkey = r_regionkey UNION ALL SELECT r_name FROM nation FULL JOIN region ON n_nationkey = r_regionkey + 3 UNION ALL SELECT r_name FROM nation CROSS JOIN region) t")
sql("sql_group", "SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) AS s, round(avg(l_quantity), 4) AS a, min(l_tax) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
# Of equal prices the smallest order key counts, as the oracle finds it in one thread over rows in this order; min_by alone takes any.
_PRICED = "CASE WHEN o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL THEN struct(o_totalprice, {}) END"
sql(
    "sql_group_first_last",
    f"SELECT o_custkey, min_by(o_orderkey, {_PRICED.format('o_orderkey')}) AS f, max_by(o_orderkey, {_PRICED.format('~o_orderkey')}) AS l, mean(o_custkey) AS m FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS f, max_by(o_orderkey, o_totalprice) AS l, mean(o_custkey) AS m FROM orders GROUP BY o_custkey",
)
sql("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC LIMIT 7")
sql("sql_beyond", "WITH t AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f FROM orders WHERE o_orderpriority LIKE '%-%') SELECT o_custkey, CAST(sum(f) AS BIGINT) AS f FROM t GROUP BY o_custkey HAVING count(*) > 1")

# Lazy chains, plans, streams


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 20")
def lazy_chain(spark, sf_dir):
    out = Frame(parquet.scan_parquet(spark, f"{sf_dir}/orders.parquet")).filter(col("o_orderstatus") == "O").group_by("o_custkey").agg_exprs(F.round(E.sum_(col("o_totalprice")), 2).alias("total"))
    return Frame(out, "o_custkey").sort("total", True).df.limit(20)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s"))
    return out.drop("window_end").withColumn("window_start", col("window_start").cast("timestamp_ntz"))


@query(
    """SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, false) AS gap FROM events)) GROUP BY user_id, g"""
)
def stream_sessions(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.drop("window_end").withColumn("window_start", col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_available_now(spark, sf_dir):
    """The events table as a stream, processed once into a table."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch(spark)
    windows.run_once(windows.drop_duplicates(source, ["event_id"], "ts", "3650 days"), path, f"{path}-checkpoint")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
