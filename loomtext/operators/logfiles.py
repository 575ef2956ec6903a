"""The event log as files: numbered physical lines, what can't be parsed, and appends that the rules guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.logrules import GUARD_CTES, append_guard
from loomtext.plans.registry import query
from loomtext.sources.applog import AppendLog
from loomtext.sources.lines import read_packed, write_packed
from loomtext.sources.scratch import Scratch, cut
from loomtext.sources.tables import LOG_LINES_SQL, log_lines, new_log_lines


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, at, raw of the log, written to packed files and read back in splits."""
    folder = f"{Scratch(spark).base}/log"
    write_packed(log_lines(spark, sf_dir), folder)
    return read_packed(spark, [folder])


@query("WITH " + LOG_LINES_SQL + " SELECT file, line, row_number() OVER (ORDER BY file, line) - 1 AS at, raw FROM log_lines")
def log_physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_files(spark, sf_dir)


@query("WITH " + LOG_LINES_SQL + " SELECT file, line, raw FROM log_lines WHERE trim(raw) <> '' AND NOT json_valid(raw)")
def log_unparsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are neither blank nor JSON, with the places that they have in their files."""
    return log_files(spark, sf_dir).where((F.trim("raw") != "") & F.try_parse_json("raw").isNull()).select("file", "line", "raw")


@query(
    GUARD_CTES
    + """ SELECT file, line, raw FROM log_lines UNION ALL SELECT y.file, coalesce(n, 0) + row_number() OVER (PARTITION BY y.file ORDER BY raw), raw
FROM _y y LEFT JOIN (SELECT file, max(line) AS n FROM log_lines GROUP BY file) l ON l.file = y.file WHERE refused IS NULL"""
)
def log_guarded_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log behind an append of those new records that the guard takes."""
    log, old, new = AppendLog(spark, f"{Scratch(spark).base}/log"), log_lines(spark, sf_dir), new_log_lines(spark, sf_dir)
    version = log.append(old, 0, guard=False)
    taken = cut(append_guard(log.lines(), cut(new)).where("refused is null").select("file", "raw"))
    return log.lines(log.append(taken, version, "raw"))
