"""Files through Hadoop's file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def single_file(spark: SparkSession, write: Callable[[str], None], path: str) -> None:
    """Let ``write`` make a folder of one part file beside ``path``, then give that file its name."""
    folder = f"{path}.{uuid.uuid4().hex}"
    write(folder)
    fs, p = _fs(spark, folder)
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    target = _fs(spark, path)[1]
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")
    fs.delete(p, True)


def joined_file(spark: SparkSession, write: Callable[[str], None], path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0) -> None:
    """Let ``write`` make a folder of part files beside ``path``, then one file of their bytes in order, but for the first ``skip``."""
    folder = f"{path}.{uuid.uuid4().hex}"
    write(folder)
    fs, p = _fs(spark, folder)
    parts = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(_fs(spark, path)[1], True)
    try:
        out.write(bytearray(head))
        for s in parts:
            source = fs.open(s.getPath())
            try:
                source.seek(skip if s is parts[0] else 0)
                copy(source, out, 1 << 20, False)
            finally:
                source.close()
        out.write(bytearray(tail))
    finally:
        out.close()
    fs.delete(p, True)
