"""Texts cut into runs of one Unicode script, words that mix scripts, and signs that don't belong in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.registry import query
from loomtext.sources.tables import table

#: Scripts that are told apart; all others are one.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")
OTHER = "Other"
#: Digits, signs and marks, which go with what is before them.
_SHARED = r"\p{IsCommon}\p{IsInherited}"


def _run_pattern() -> str:
    """A letter of a script, and all signs behind it of that script or of none. Classes alone, which long runs can't overflow."""
    others = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
    return "|".join([*(rf"\p{{Is{s}}}[\p{{Is{s}}}{_SHARED}]*" for s in SCRIPTS), f"[^{_SHARED}{others}][^{others}]*"])


def script_of(sign: Column) -> Column:
    """The script of a run's first sign."""
    found = F
    for script in SCRIPTS:
        found = found.when(sign.rlike(rf"^\p{{Is{script}}}"), script)
    return found.otherwise(OTHER)


def script_runs(texts: DataFrame) -> DataFrame:
    """id, text -> id, nth (from 1), script, text of each run: a letter of a script and all that follows of it or of none.

    What comes before the first letter is in no run; the other runs tile the text. Null texts have none.
    """
    runs = F.regexp_extract_all("text", F.lit(_run_pattern()), F.lit(0))
    found = texts.select("id", F.posexplode(runs).alias("_n", "text"))
    return found.select("id", (F.col("_n") + 1).cast("long").alias("nth"), script_of(F.col("text")).alias("script"), "text")


def mixed_words(texts: DataFrame) -> DataFrame:
    """id, text -> id, nth, word, scripts: words with letters of several scripts. Kanji and kana of one word are no mixture."""
    words = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("_n", "word"))
    present = F.array_compact(F.array(*[F.when(F.col("word").rlike(rf"\p{{Is{s}}}"), s) for s in SCRIPTS]))
    japanese = F.array(*[F.lit(s) for s in ("Han", "Hiragana", "Katakana")])
    found = words.withColumn("scripts", present).where((F.size("scripts") > 1) & (F.size(F.array_except("scripts", japanese)) > 0))
    return found.select("id", (F.col("_n") + 1).cast("long").alias("nth"), "word", F.array_join("scripts", "+").alias("scripts"))


def stray_signs(texts: DataFrame) -> DataFrame:
    """id, text -> id, controls, stray_crs: control signs other than tab and line ends, and CRs that no LF follows."""
    counts = texts.select("id", F.regexp_count("text", F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")).cast("long").alias("controls"), F.regexp_count("text", F.lit(r"\r(?!\n)")).cast("long").alias("stray_crs"))
    return counts.select("id", F.coalesce("controls", F.lit(0)).cast("long").alias("controls"), F.coalesce("stray_crs", F.lit(0)).cast("long").alias("stray_crs"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


# DuckDB has the same classes under their plain names.
_DUCK_RUNS = _run_pattern().replace(r"\p{Is", r"\p{")
_DUCK_SCRIPT = "CASE " + " ".join(rf"WHEN regexp_matches(text, '^\p{{{s}}}') THEN '{s}'" for s in SCRIPTS) + f" ELSE '{OTHER}' END"


@query(
    f"WITH r AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '{_DUCK_RUNS}') AS x FROM documents)) "
    f"SELECT doc_id AS id, nth, {_DUCK_SCRIPT} AS script, length(text) AS chars, md5(text) AS digest FROM r",
    "script_runs",
)
def script_runs_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_runs(_documents(spark, sf_dir)).select("id", "nth", "script", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(
    "WITH t AS (SELECT page_id AS id, html AS text FROM pages), w AS (SELECT id, unnest(x) AS word, generate_subscripts(x, 1) AS nth FROM (SELECT id, regexp_extract_all(text, '[\\p{L}\\p{M}]+') AS x FROM t)), s AS (SELECT *, list_filter(["
    + ", ".join(rf"CASE WHEN regexp_matches(word, '\p{{{s}}}') THEN '{s}' END" for s in SCRIPTS)
    + "], lambda x: x IS NOT NULL) AS p FROM w) SELECT id, nth, word, array_to_string(p, '+') AS scripts FROM s WHERE len(p) > 1 AND len(list_filter(p, lambda x: x NOT IN ('Han', 'Hiragana', 'Katakana'))) > 0",
    "mixed_script_words",
)
def mixed_words_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")))


@query(
    "WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents) SELECT id, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) AS controls, "
    "(length(text) - length(replace(text, chr(13), ''))) - (length(text) - length(replace(text, chr(13) || chr(10), ' '))) AS stray_crs FROM t",
    "stray_signs",
)
def stray_signs_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stray_signs(_documents(spark, sf_dir))
