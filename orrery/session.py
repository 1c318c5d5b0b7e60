"""The engine's session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine's semantics rely on, and the adaptive execution it leaves sizing to.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(name: str = "orrery", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` (dots as double underscores) come on top."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
