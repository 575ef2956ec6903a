"""Tables that go through files of other formats and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.registry import query
from loomtext.sources.datasource import register
from loomtext.sources.scratch import Scratch
from loomtext.sources.tables import table

#: Rows of a file of vectors.
BLOCK = 4096


@query("SELECT item_id, text FROM benchmark")
def charset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as a GB 18030 file each (which has all of Unicode), read back by their names."""
    register(spark)
    folder = f"{Scratch(spark).base}/charset"
    texts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    texts.write.format("loomtext_charset").option("charset", "gb18030").mode("append").save(folder)
    back = spark.read.format("loomtext_charset").option("charset", "gb18030").load(folder)
    return back.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("item_id"), "text")


@query("SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS width, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings WHERE label % 2 = 0")
def npy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as .npy files of one label and one block of ids each, beside a manifest of their rows; even labels are read back.

    The labels' folders are a filter on path, so files of other labels are not opened.
    """
    register(spark)
    scratch = Scratch(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("values"), F.floor(F.col("vec_id") / BLOCK).alias("block"))
    name = F.concat(F.lit("label-"), F.col("label").cast("string"), F.when(F.col("label") % 2 == 0, "-even/").otherwise("-odd/"), F.col("block").cast("string"), F.lit(".npy"))
    named = vectors.withColumn("path", name)
    named.repartition("path").sortWithinPartitions("path", "vec_id").select("path", "values").write.format("loomtext_npy").mode("append").save(f"{scratch.base}/npy")
    ids = F.sort_array(F.collect_list("vec_id"))
    manifest = scratch.write(named.groupBy("path", "label").agg(ids.alias("ids")).select("path", "label", F.posexplode("ids").alias("row", "vec_id")), "manifest")
    back = spark.read.format("loomtext_npy").load(f"{scratch.base}/npy").where(F.col("path").contains("-even/"))
    rows = back.withColumn("path", F.regexp_extract("path", r"/(label-[^/]+/[^/]+)$", 1))
    found = rows.join(manifest, ["path", "row"])
    return found.select("vec_id", "label", F.size("values").cast("long").alias("width"), F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last"))
