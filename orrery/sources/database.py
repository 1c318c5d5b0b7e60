"""Databases: by JDBC, or by any Python DB-API module."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query's rows by JDBC (the driver's jar must be on the class path).

    ``partition`` (column, lower, upper, number) reads in parallel by ranges of a column.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        name, low, high, n = partition
        return reader.option("dbtable", f"({query}) t").options(partitionColumn=name, lowerBound=low, upperBound=high, numPartitions=n).load()
    return reader.option("query", query).load()


def _kind(values: list) -> str:
    """By the first value that isn't null."""
    v = next((v for v in values if v is not None), None)
    for python, spark in ((bool, "boolean"), (int, "bigint"), (float, "double"), (decimal.Decimal, "decimal(38,18)"), (datetime.datetime, "timestamp_ntz"), (datetime.date, "date"), (bytes, "binary")):
        if isinstance(v, python):
            return spark
    return "string"


def read_rows(spark: SparkSession, cursor, schema: str | StructType | None = None) -> DataFrame:
    """The rows of an open cursor; they pass through the driver, so this is for small results."""
    names = [d[0] for d in cursor.description]
    rows = [tuple(r) for r in cursor.fetchall()]
    if schema is None:
        kinds = [_kind([r[i] for r in rows]) for i in range(len(names))]
        schema = _parse_datatype_string(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
        fit = [float if k == "double" else str if k == "string" else None for k in kinds]
        rows = [tuple(x if x is None or f is None else f(x) for f, x in zip(fit, r, strict=True)) for r in rows]
    return spark.createDataFrame(rows, schema)


def read_sql(spark: SparkSession, connect: Callable, query: str, params: tuple = (), schema: str | StructType | None = None) -> DataFrame:
    """A query's rows through a DB-API connection that ``connect`` opens on the driver."""
    connection = connect()
    try:
        cursor = connection.cursor()
        cursor.execute(query, params)
        return read_rows(spark, cursor, schema)
    finally:
        connection.close()


def read_sql_parallel(spark: SparkSession, connect: Callable, query: str, parts: list[tuple], schema: str, batch: int = 10_000) -> DataFrame:
    """A query run once for each tuple of parameters, by the executors, which open their own connections."""
    kinds = _parse_datatype_string(schema)

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                connection = connect()
                try:
                    cursor = connection.cursor()
                    cursor.execute(query, parts[i])
                    while rows := cursor.fetchmany(batch):
                        yield pd.DataFrame([tuple(r) for r in rows], columns=kinds.names)
                finally:
                    connection.close()

    return spark.range(len(parts), numPartitions=max(1, len(parts))).mapInPandas(run, kinds)
