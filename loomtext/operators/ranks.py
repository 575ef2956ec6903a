"""Medians, ordinals, pages, gaps and vocabularies by ranks that many tasks make together, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.registry import query
from loomtext.sources.scratch import cut, global_rank, group_rank
from loomtext.sources.tables import TOKENS_SQL, table, tokens


def median(rows: DataFrame, group: str, value: str, upper: bool) -> DataFrame:
    """group, m: the value at floor(n / 2), or for the lower median at floor((n - 1) / 2), of each group in ascending order."""
    ranked = group_rank(rows.select(group, value), group, [value])
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    at = F.floor((F.col("_n") - (0 if upper else 1)) / 2)
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("rank") == at).select(group, F.col(value).alias("m"))


_MEDIAN_SQL = "SELECT event_type, value AS m FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) x WHERE k = floor({at} / 2)"


@query(_MEDIAN_SQL.format(at="n"))
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median(table(spark, sf_dir, "events"), "event_type", "value", True)


@query(_MEDIAN_SQL.format(at="(n - 1)"))
def median_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median(table(spark, sf_dir, "events"), "event_type", "value", False)


@query("WITH " + TOKENS_SQL + " SELECT token, n, CAST(3 + row_number() OVER (ORDER BY token) AS BIGINT) AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tokens WHERE lang = 'de') x GROUP BY token HAVING count(*) >= 2) y")
def vocab_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that occur twice or more, numbered from 4 on (four ids are reserved) in order."""
    counted = tokens(spark, sf_dir).where("lang = 'de'").select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return global_rank(counted, ["token"]).select("token", "n", (F.col("rank") + 4).alias("id"))


@query("SELECT doc_id, source, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY f) - 1 AS BIGINT) AS ordinal FROM (SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents) x")
def paragraph_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered in each language by their first document; only one row for each source is ranked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("f"))
    ranked = group_rank(first, "lang", ["f"]).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("rank").alias("ordinal"))
    return docs.join(ranked, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "ordinal")


@query("SELECT doc_id + 1 AS first_missing, nxt - 1 AS last_missing FROM (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS nxt FROM labels) x WHERE nxt > doc_id + 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers that are missing: a gap lies between a number without its successor and the next one by rank."""
    ranked = cut(global_rank(table(spark, sf_dir, "labels").select("doc_id").where("doc_id IS NOT NULL").distinct(), ["doc_id"]))
    after = ranked.select(F.col("doc_id").alias("nxt"), (F.col("rank") - 1).alias("_r"))
    return ranked.join(after, F.col("rank") == F.col("_r")).where("nxt > doc_id + 1").select((F.col("doc_id") + 1).alias("first_missing"), (F.col("nxt") - 1).alias("last_missing"))


@query("SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 12) AS BIGINT) AS page FROM documents")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 12)


def pages_of(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """rows with the page (from 0) that each is on, `size` rows of a group to a page."""
    if size < 1:
        raise ValueError(f"a page takes a row at least, not {size}")
    return group_rank(rows, group, order).withColumn("page", F.floor(F.col("rank") / size)).drop("rank")
