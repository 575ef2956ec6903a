"""Spark session with the settings that the library's plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(name: str = "loomtext", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session on local cores, or on what spark-submit names; AQE splits skewed joins and merges small partitions."""
    builder = SparkSession.builder.appName(name)
    if "SPARK_MASTER" not in os.environ and cpus:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
