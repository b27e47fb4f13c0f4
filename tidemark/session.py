"""The session that the library's queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, *, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution and ANSI arithmetic; what a cluster sets itself (memory, partitions) is left to it."""
    builder = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
