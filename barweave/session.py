"""Session factory with the settings this engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "barweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
