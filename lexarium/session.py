"""Spark session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lexarium", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting, Arrow transfer; ``conf`` (with _ for .) goes on top."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
