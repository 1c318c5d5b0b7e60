"""Shared helpers: shared-folder tables, size-checked broadcasts and input shaping."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of a few numbers each (some tens of MB) may be broadcast.
BROADCAST_ROWS = 1_000_000

_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, only the steps
    after this table are run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def tables() -> set[str]:
    """The paths of the tables that exist, for :func:`release`."""
    return set(_tables)


def release(keep: set[str] = frozenset()) -> None:
    """Delete the tables that :func:`materialize` wrote, but those to keep; no result to come may read them."""
    for path in [p for p in _tables if p not in keep]:
        spark = _tables.pop(path)
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and with it the means to delete
            return


atexit.register(release)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``most`` rows, as counted; else leave the choice of join to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Return freed memory to the system; a worker is kept for later stages, and what it holds on to adds to theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def frugal(run: Callable) -> Callable:
    """``run`` over batches, giving back its memory when it ends."""

    def all_batches(batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_batches


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package on the path of local Python workers.

    On a cluster the package is installed or passed with ``--py-files``.
    """
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return df.mapInArrow(frugal(run), schema)


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
