"""Sharding by extendible hashing, in DataFrame functions only.

Method. A row's key is hashed to 60 bits. The directory is indexed by a prefix
of these bits; a bucket whose rows fit the byte limit is a shard, and only an
oversized bucket is split on the next bit. All prefixes are weighed at once:
bytes are summed by the longest prefix first (sums of sums from there on), and a
shard is the shortest prefix that fits while the one before does not. Buckets
that are oversized at the longest prefix are looked at again with more bits.

A bucket whose rows all share one hash can't be split: it gets overflow pages. Its
rows are dealt to groups of about ``GROUP`` pages first, so that a key of any
number of rows is paged by many tasks. A row larger than the limit is a shard of its own.

Defined cases. A null key is hashed as the empty string, a null text has no
bytes. Copies of one key stay in one bucket until it overflows. An empty table
gives an empty result. Input columns besides key and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

BITS = 60
#: Bytes of a shard at most.
LIMIT = 16 * 1024 * 1024
#: Bits by which the directory goes beyond what even buckets would need, and by which it grows.
SLACK, MORE = 4, 8
#: Overflow pages that are filled one after another.
GROUP = 64


def key_hash(key: str) -> str:
    """60 bits of the key's MD5, as a bigint."""
    return f"cast(conv(substring(md5(coalesce(cast(`{key}` as string), '')), 1, 15), 16, 10) as bigint)"


def directory(rows: DataFrame, limit: int, bits: int, start: int = 0) -> DataFrame:
    """(cell, depth, bytes) by prefix of ``bits`` bits: the shard it belongs to, or depth null if all are oversized."""
    cells = rows.groupBy(F.expr(f"shiftright(h, {BITS - bits})").alias("cell")).agg(F.sum("bytes").alias("bytes"))
    paths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    nodes = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"))
    fits = paths.drop("bytes").join(nodes, ["depth", "prefix"]).filter(f"sum <= {limit}")
    best = fits.groupBy("cell").agg(F.min_by(F.struct("depth", "sum"), "depth").alias("b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "b.depth", F.col("b.sum").alias("shard_bytes"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> list:
    return [F.expr(key_hash(id_col)).alias("h"), F.expr(f"cast(coalesce(octet_length(cast(`{text_col}` as string)), 0) as bigint)").alias("bytes")]


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, which have h, bytes and row (any value), each once, with shard, depth and shard_bytes."""
    kept = ["row", "shard", "depth", "bytes", "shard_bytes"]
    large = materialize(rows.filter(f"bytes > {limit}").withColumn("r", F.monotonically_increasing_id()), "large")
    numbers = large.select("r", F.row_number().over(Window.partitionBy("h").orderBy("bytes", "r")).alias("n"))
    shard = F.expr(f"concat(lpad(bin(h), {BITS}, '0'), '-row', n)")
    out = large.join(numbers, "r").withColumns({"shard": shard, "depth": F.lit(BITS), "shard_bytes": F.col("bytes")}).select(kept)
    left = rows.filter(f"bytes <= {limit}")
    total = left.agg(F.sum("bytes")).first()[0] or 0
    bits, start = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SLACK), 0
    while True:
        found = materialize(directory(left, limit, bits, start), "directory")
        placed = left.withColumn("cell", F.expr(f"shiftright(h, {BITS - bits})")).join(small(found), "cell")
        shard = F.expr(f"if(depth = 0, '', lpad(bin(shiftright(h, {BITS} - depth)), depth, '0'))")
        out = out.union(placed.filter("depth is not null").withColumn("shard", shard).select(kept))
        over = found.filter("depth is null").select("cell")
        if over.isEmpty():
            return out
        if bits == BITS:
            break
        left = left.withColumn("cell", F.expr(f"shiftright(h, {BITS - bits})")).join(small(over), "cell", "left_semi").drop("cell")
        bits, start = min(BITS, bits + MORE), bits
    # One hash throughout: pages of at most the limit, as no row takes more than the page's second half.
    same = left.join(small(over.withColumnRenamed("cell", "h")), "h", "left_semi")
    same = materialize(same.withColumn("r", F.monotonically_increasing_id()), "overflow")
    sums = same.groupBy("h").agg(F.max("bytes").alias("most"), F.ceil(F.sum("bytes") / (limit * GROUP)).alias("groups"))
    same = same.join(small(materialize(sums, "hashes")), "h").withColumn("g", F.pmod(F.xxhash64("r"), F.col("groups")))
    before = F.sum("bytes").over(Window.partitionBy("h", "g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    paged = same.withColumn("page", F.floor(F.coalesce(before, F.lit(0)) / F.greatest(F.lit(1), F.lit(limit) - F.col("most"))))
    weight = F.sum("bytes").over(Window.partitionBy("h", "g", "page"))
    name = F.expr(f"concat(lpad(bin(h), {BITS}, '0'), '-page', g, '.', page)")
    return out.union(paged.withColumns({"shard": name, "depth": F.lit(BITS), "shard_bytes": weight}).select(kept))


def assign(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``shard`` (its prefix in bits, and overflow page or row if any), ``depth``, ``bytes`` and ``shard_bytes`` of every row."""
    rows = materialize(df.select(F.col(id_col).alias("row"), *_keyed(df, id_col, text_col)), "rows")
    return _placed(rows, limit).select(F.col("row").alias(id_col), "shard", F.col("depth").cast("int").alias("depth"), "bytes", F.col("shard_bytes").cast("long").alias("shard_bytes"))


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows, each once, below ``path``, a folder ``shard=...`` for each shard; a column named shard is replaced."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "shard"]).alias("row"), *_keyed(df, id_col, text_col))
    _placed(rows, limit).select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)


#: The same assignment in SQL, for tables whose directory stays within 30 bits and whose rows all fit.
SQL = f"""
WITH r AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes FROM documents),
n AS (SELECT d, h >> (60 - d) AS p, CAST(sum(bytes) AS BIGINT) AS s FROM r, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 31)) GROUP BY ALL),
leaf AS (SELECT n.* FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.p = n.p >> 1 WHERE n.s <= {LIMIT} AND (n.d = 0 OR q.s > {LIMIT}))
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), d) END AS shard, d AS depth, bytes, s AS shard_bytes
FROM r JOIN leaf ON r.h >> (60 - leaf.d) = leaf.p
"""
