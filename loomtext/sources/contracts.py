"""Tables that are only published if their invariants hold, which are counted while the rows are written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Violated(Exception):
    """Rules that some rows break; .counts has how many of each."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(", ".join(f"{n} rows against: {rule}" for rule, n in counts.items()))
        self.counts = counts


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], totals: dict[str, Column] | None = None) -> dict[str, int]:
    """Write df as Parquet to a new folder, if no row breaks a rule; returns the rows, and what each rule and total counted.

    rules: what holds for each row; null counts as broken. totals: aggregates that have to be true of the whole table, like
    a sum that is known. The rows are read once: Spark counts (`observe`) as it writes them to a folder beside the path, which
    is moved into place if all is well and removed if not. A path that exists is refused.
    """
    spark, totals = df.sparkSession, totals or {}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    final, draft = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    counted = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    whole = [F.when(F.coalesce(total, F.lit(False)), F.lit(0)).otherwise(F.lit(1)).cast("long").alias(name) for name, total in totals.items()]
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *counted, *whole).write.parquet(str(draft.toString()))
        found = {"rows": 0} | {k: int(v) for k, v in seen.get.items()}
        broken = {k: n for k, n in found.items() if n and k != "rows"}
        if broken:
            raise Violated(broken)
        if not fs.rename(draft, final):
            raise FileExistsError(path)
        return found
    finally:
        fs.delete(draft, True)


def report(spark: SparkSession, found: dict[str, int]) -> DataFrame:
    """rule, violations of what write_checked() counted."""
    return spark.createDataFrame([(k, n) for k, n in found.items() if k != "rows"], "rule string, violations long")
