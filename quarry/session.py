"""A SparkSession with the settings this library assumes: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarry", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
