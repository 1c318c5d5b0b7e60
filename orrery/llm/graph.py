"""Connected components by alternating star contractions, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every node that has an edge to another; label is its component's smallest id.

    Each round links the larger neighbours of every node to its smallest
    neighbour, then all smaller ones; the number of rounds grows with the
    logarithm of the graph. Edges stay in tables of the shared folder, rounds
    exchange them by node, and only two numbers a round reach the driver. Edges
    with a null end and loops are ignored; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u > v").distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select("v", "v")).distinct()
        state = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = materialize(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
