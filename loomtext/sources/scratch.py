"""Intermediate tables in the folder that executors share, and ranks over whole tables that no single task makes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; on local cores alone, set one where none is named.

    What is written there goes when the driver's JVM ends.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Have the shuffle files of what runs in here removed when it ends.

    Behind a checkpoint or a written table nothing reads them again, but Spark keeps them until the driver's JVM happens to
    collect the plans that wrote them, by when the disks may be full.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


class Scratch:
    """Tables that an operator writes to the shared checkpoint folder for itself, columnar and compressed."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove a table, or all."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with the place of each row, from 0, in the order of some columns; equal rows stand in any order.

    A range partitioning orders the rows over tasks; a row's rank is its place in its task after the sizes of the tasks
    before, of which there is one row for each task. Places are written before they are used, as ranges are sampled.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn(out, F.col("_before") + F.col("_i")).drop("_p", "_q", "_i", "_before")


def group_rank(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """df with the place of each row, from 0, in its group; a group of any size is ranked by many tasks. Nulls are a group."""
    ranked = global_rank(df, [group, *order], "_all")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_all").alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(out, F.col("_all") - F.col("_first")).drop("_g", "_first", "_all")
