"""A session with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strandline", master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution is on, so that partitions are merged, skewed joins split and small sides sent at run time.

    ``conf`` names use ``__`` for dots: ``session(spark__sql__shuffle__partitions=2000)``.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
