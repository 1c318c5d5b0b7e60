"""Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import single_file


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All row groups, encodings and nested types; Spark reads the columns and row groups that a query needs."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


scan_parquet = read_parquet


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] = (), single: bool = False) -> None:
    """A folder of files (``none``, ``snappy``, ``gzip``, ``zstd``, ``lz4``), or with ``single`` one file."""
    if single:
        single_file(df.sparkSession, lambda to: df.coalesce(1).write.option("compression", compression).parquet(to), path)
        return
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, sort: list[str] = ()) -> None:
    """A table whose rows lie in buckets of the keys, so that joins and groups on them need no exchange."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
