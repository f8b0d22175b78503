"""A session with settings that hold from a laptop to a large cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "chiffra", **more: str) -> SparkSession:
    """AQE splits skewed joins and merges small partitions; the initial partition number is generous for that reason."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in {**conf, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
