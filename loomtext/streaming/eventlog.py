"""The event log as a stream. An extension: the batch queries of loomtext.operators.eventlog define what is effective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of a log line: loop, line, event, value, ts, and the line that a correction supersedes.
LOG_SCHEMA = "loop long, line long, event string, value double, ts timestamp, supersedes long"


def read_log(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """Log lines from Parquet files as they arrive."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts_by_window(log: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window of event time; lines later than the watermark are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def net_counts(log: DataFrame) -> DataFrame:
    """Lines of each kind in each loop and retractions that name a line; state is one row for each loop."""
    return log.groupBy("loop").agg(F.count(F.when(F.col("event") != "correction", 1)).alias("lines"), F.count("supersedes").alias("retracted"))


def voided_lines(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Each line with the correction that voids it, joined as both arrive within `late` of each other."""
    lines = log.where("event <> 'correction'").withWatermark("ts", late).alias("l")
    fixes = log.where("event = 'correction'").withWatermark("ts", late).alias("c")
    return lines.join(
        fixes,
        F.expr(f"c.loop = l.loop AND c.supersedes = l.line AND c.line > l.line AND c.ts >= l.ts - INTERVAL {late} AND c.ts <= l.ts + INTERVAL {late}"),
    ).select("l.loop", "l.line", F.col("c.line").alias("by_line"))
