"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The operators take these from here.
from loomtext.sources.scratch import Scratch, cut  # noqa: F401

# A word is a run of anything but the six ASCII blanks; bytes.split() splits at just those.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    blank_ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - blank_ends).cast("long")


def bucketed_rank(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """0-based rank of each row in its group, in an order that depends on the rows' values alone.

    Rows are dealt to hash buckets of `order`, each bucket is ranked by itself, and the buckets' sizes (at most
    `buckets` rows for each group) give what comes before it. So no group, however large, meets in one task.
    """
    b = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("_b", b)
    before = (
        rows.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
        .select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_g_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = rows.withColumn("_pos", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)) - 1)
    on = [ranked[c].eqNullSafe(before[f"_g_{c}"]) for c in group] + [ranked["_b"] == before["_g_b"]]
    return (
        ranked.join(before, on)
        .withColumn(out, (F.col("_before") + F.col("_pos")).cast("long"))
        .drop("_b", "_g_b", "_before", "_pos", *[f"_g_{c}" for c in group])
    )


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit hash of two, element by element; both orders differ."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        x ^= x >> np.uint64(32)
        return x * np.uint64(0x94D049BB133111EB)


def hash_words(words: Iterable[bytes], n: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out, words[k : len(words) - n + 1 + k])
    return out ^ (out >> np.uint64(31))


def byte_texts(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column of an Arrow batch; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()
    return [x or b"" for x in batch.column(name).cast(kind).to_pylist()]


def with_held_out(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """held_out: whether crc32 of doc_id as text leaves that remainder; false where doc_id is null."""
    return df.withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    )


def label_column(spark: SparkSession, labels: DataFrame, name: str) -> DataFrame:
    """doc_id and 0/1, one row for each labelled doc_id; rows that contradict each other take the mean, half counts as 1."""
    return (
        labels.select("doc_id", F.col(name).cast("double").alias("_y"))
        .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("_y") >= 0.5).cast("double").alias("label"))
    )
