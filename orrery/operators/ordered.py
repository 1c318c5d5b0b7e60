"""Expressions over a whole ordered table, without bringing it into one task.

A window without partition would sort all rows in one task. Here rows are
numbered in two passes instead: rows are dealt into buckets of the order key by
boundaries from a small random sample (they steer the balance only), each
bucket numbers its rows, and the buckets' row counts say where each begins.
Numbers then cut the table into chunks of equal size, which are windows of
their own: an expression that looks some rows back or ahead gets these rows from
the neighbouring chunk as well, and one that accumulates gets what the chunks
before have in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.expr import Ordered, Rank, between, following

#: Rows of a chunk, buckets of the order key, rows sampled for their boundaries, and parts of the rows of a hot key.
CHUNK, BUCKETS, SAMPLED, PARTS = 1_000_000, 256, 4096, 16

RN = "__rn"


def boundaries(df: DataFrame, key: Column, buckets: int = BUCKETS) -> list:
    """Values that cut the key into buckets, in order, from a sample of the rows; one that fills whole buckets comes more than once."""
    sample = [r["k"] for r in df.select(key.alias("k")).filter("k is not null").orderBy(F.rand(7)).limit(SAMPLED).collect()]
    sample.sort(key=lambda v: (v != v, v))  # NaN is the largest number
    step = max(1, len(sample) // buckets)
    return sample[step::step]


def bucket_of(key: Column, bounds: list, kind: DataType) -> Column:
    """How many of the sorted bounds are at most the key; blocks of bounds are counted first, then the bounds of one block."""
    literals = [F.lit(b).cast(kind) for b in bounds]
    block = max(1, int(len(bounds) ** 0.5))
    at_most = lambda x: F.size(F.filter(x, lambda b: b <= key))
    skipped = at_most(F.array(*literals[block - 1 :: block])) * block
    return skipped + at_most(F.slice(F.array(*literals), skipped + 1, block))


def number_rows(df: DataFrame, order: list[Column], name: str = RN, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with each row's number, from 1, in the given order (nulls last); ties are numbered in any order.

    A value that fills whole buckets of the sample is hot: if it is the whole
    order key, its rows are dealt out further, as their order is free.
    """
    key = order[0]
    if any(x in str(key) for x in (" ASC", " DESC")):
        raise ValueError("the order key is a column; its direction is ascending")
    cuts = boundaries(df, key, buckets)
    bounds = list(dict.fromkeys(cuts))
    hot = [b for b in bounds if cuts.count(b) > 1] if len(order) == 1 else []
    out = df.withColumn("__key", key)
    if bounds:
        at = bucket_of(F.col("__key"), bounds, out.schema["__key"].dataType)
        out = out.withColumn("__bucket", F.when(F.col("__key").isNull(), F.lit(len(bounds) + 1)).otherwise(at))
    else:
        out = out.withColumn("__bucket", F.when(F.col("__key").isNull(), 1).otherwise(0))
    if hot:
        # A hot value is a boundary, so its rows come first in their bucket.
        part = F.when(F.col("__key").isin(hot), F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))).otherwise(PARTS)
        out = out.withColumn("__bucket", F.col("__bucket") * (PARTS + 1) + part)
    sizes = out.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__bucket").orderBy(*[F.asc_nulls_last(c) for c in order]))
    # At most (buckets + 2) * (PARTS + 1) rows on the right.
    return out.withColumn("__local", local).join(F.broadcast(starts), "__bucket").withColumn(name, F.col("__start") + F.col("__local")).drop("__bucket", "__key", "__local", "__start")


def evaluate(df: DataFrame, order: list[Column], exprs: dict[str, Ordered], chunk: int = CHUNK) -> DataFrame:
    """``df`` with the expressions as columns; those of one name replace the column of that name at the end."""
    final = {name: f"__out{i}" for i, name in enumerate(exprs)}
    out = number_rows(df, order)
    near = {n: e for n, e in exprs.items() if e.reach is not None}
    if near:
        back, ahead = (max(e.reach[k] for e in near.values()) for k in (0, 1))
        size = max(chunk, back, ahead, 1)
        own = F.floor((F.col(RN) - 1) / size)
        at = (F.col(RN) - 1) % size
        chunks = F.array_compact(F.array(own, F.when(at >= size - back, own + 1), F.when(at < ahead, own - 1)))
        out = out.withColumn("__own", own).withColumn("__chunk", F.explode(chunks))
        w = Window.partitionBy("__chunk").orderBy(RN)
        out = out.withColumns({final[n]: e.build(w) for n, e in near.items()})
        out = out.filter("__own = __chunk").drop("__own", "__chunk")
    carried = {final[n]: e for n, e in exprs.items() if e.reach is None and not isinstance(e, Rank)}
    if carried:
        out = _carried(out, carried, chunk)
    for name, e in exprs.items():
        if isinstance(e, Rank):
            out = _rank(out, final[name], e)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in final], *[F.col(final[n]).alias(n) for n in final], RN)


def _carried(df: DataFrame, exprs: dict[str, Ordered], chunk: int) -> DataFrame:
    """Running aggregates and fills: within the chunk, and what its neighbours hand on; all of them at once."""
    before, upto = Window.unboundedPreceding, 0
    df = df.withColumn("__chunk", F.floor((F.col(RN) - 1) / chunk))
    w = Window.partitionBy("__chunk").orderBy(RN)
    all_chunks = Window.orderBy("__chunk")
    totals, carries, here, values = [], [], {}, {}
    for i, (name, e) in enumerate(exprs.items()):
        a = e.value
        t, c, h, f, n, b, x = (f"__{k}{i}" for k in "tchfnbx")
        if e.kind in ("sum", "product", "min", "max"):
            over = getattr(F, e.kind)
            totals += [over(a).alias(t)]
            carries += [over(t).over(all_chunks.rowsBetween(before, -1)).alias(c)]
            here[h] = over(a).over(w.rowsBetween(before, upto))
            both = {"sum": lambda x, y: x + y, "product": lambda x, y: x * y, "min": F.least, "max": F.greatest}[e.kind]
            values[name] = F.when(a.isNotNull(), F.when(F.col(c).isNull(), F.col(h)).otherwise(both(F.col(c), F.col(h))))
            continue
        known = F.when(a.isNotNull(), F.struct(F.col(RN).alias("x"), a.alias("y")))
        at = F.when(a.isNotNull(), F.col(RN))
        totals += [F.max_by(known, at).alias(t), F.min_by(known, at).alias(f)]
        carries += [F.last(t, True).over(all_chunks.rowsBetween(before, -1)).alias(c), following(F.col(f), all_chunks).alias(n)]
        here |= {b: F.last(known, True).over(w.rowsBetween(before, upto)), x: F.coalesce(known, following(known, w))}
        prev, after = F.coalesce(b, c), F.coalesce(x, n)
        if e.kind == "ffill":
            values[name] = prev["y"]
        elif e.kind == "bfill":
            values[name] = after["y"]
        else:
            values[name] = between(a, F.col(RN), prev["x"], prev["y"].cast("double"), after["x"], after["y"].cast("double"))
    carry = df.groupBy("__chunk").agg(*totals).select("__chunk", *carries)
    out = df.withColumns(here).join(carry, "__chunk")
    return out.select(*[F.col(f"`{k}`") for k in df.columns if k != "__chunk"], *[v.alias(k) for k, v in values.items()])


def _rank(df: DataFrame, name: str, e: Rank) -> DataFrame:
    """Ranks from row numbers by value; equal values are brought together by their value, not in a window."""
    df = df.withColumn("__v", e.value)
    if e.kind == "ordinal":
        out = number_rows(df, [F.col("__v"), F.col(RN)], "__r")
        return out.withColumn(name, F.when(F.col("__v").isNotNull(), F.col("__r").cast("double"))).drop("__r", "__v")
    values = df.groupBy("__v").agg(F.count(F.lit(1)).alias("__n")).filter("__v is not null")
    by_value = number_rows(values, [F.col("__v")], "__d")
    if e.kind == "dense":
        ranks = by_value.select(F.col("__v").alias("__k"), F.col("__d").cast("double").alias("__r"))
    else:
        rows = number_rows(df.select("__v").filter("__v is not null"), [F.col("__v")], "__d").groupBy("__v").agg(F.min("__d").alias("a"), F.max("__d").alias("b"))
        value = {"min": F.col("a").cast("double"), "max": F.col("b").cast("double"), "average": (F.col("a") + F.col("b")) / 2}[e.kind]
        ranks = rows.select(F.col("__v").alias("__k"), value.alias("__r"))
    return df.join(ranks, F.col("__v") == F.col("__k"), "left").withColumn(name, F.col("__r")).drop("__v", "__k", "__r")
