"""Windowed aggregates and duplicates over streams with late data.

All of these work on a static frame too, where the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import col, cols


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    df = df.withColumn(time, col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, length: str, keys: list[str], *aggregates: Column, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates of windows of a length, sliding if ``slide`` is given."""
    w = F.window(col(time), length, slide) if slide else F.window(col(time), length)
    out = _timed(df, time, late).groupBy(w, *cols(*keys)).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    """Aggregates of sessions, which end after a gap without rows."""
    out = _timed(df, time, late).groupBy(F.session_window(col(time), gap), *cols(*keys)).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *[c for c in out.columns if c != "session_window"])


def drop_duplicates(df: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; on a stream, keys are forgotten as the watermark passes."""
    df = _timed(df, time, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it as Parquet and stop; started again, it goes on from there."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
