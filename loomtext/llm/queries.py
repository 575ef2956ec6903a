"""The queries opN_<name> of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loomtext.llm import fingerprint, language, mixing, neardup, packing, quality, repair, rules, substrings, tokens, toxicity, treejoin, trie
from loomtext.llm.common import read_table
from loomtext.llm.conversation_sql import REPAIR_SQL, TRIE_SQL


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions")


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(read_table(spark, sf_dir, "documents"))


def op8_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"), *rules.held_apart(rules.trusted_by_label(read_table(spark, sf_dir, "labels"))))


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair.repair_conversations(repair.damage(read_table(spark, sf_dir, "conversations")))
    return repaired.withColumn("repaired_sha256", repair.repaired_digest(F.col("repaired"))).drop("repaired")


def op13_ngram_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treejoin.ngram_join(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_weighted_fingerprints": op3_weighted_fingerprints,
    "op4_suffix_tree_dedup": op4_suffix_tree_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_attribution": op7_token_attribution,
    "op8_ngram_ratio_rules": op8_ngram_ratio_rules,
    "op9_language_fusion": op9_language_fusion,
    "op10_bin_slack_packing": op10_bin_slack_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ngram_tree_join": op13_ngram_tree_join,
}

_WORDS = r"_w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents))"



def _near_sql(width: int, percent: int, kept: str = "") -> str:
    """Components of documents whose sets of word shingles are alike; kept: more columns."""
    return (
        "WITH RECURSIVE "
        + _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
        + f""",
_g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS s FROM _w),
_s AS (SELECT DISTINCT doc_id, s FROM _g WHERE pos <= n - {width - 1} OR n < {width} AND pos = 1),
_n AS (SELECT doc_id, count(*) AS n FROM _s GROUP BY doc_id),
_c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM _s a JOIN _s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
_l AS (SELECT a, b FROM _c JOIN _n x ON x.doc_id = a JOIN _n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
_e AS (SELECT a, b FROM _l UNION ALL SELECT b, a FROM _l),
_r AS (SELECT DISTINCT a AS d, a AS reach FROM _e UNION SELECT _r.d, _e.b FROM _r JOIN _e ON _e.a = _r.reach),
_m AS (SELECT d, min(reach) AS m FROM _r GROUP BY d)
SELECT d.doc_id, coalesce(_n.n, 0) AS n_shingles, coalesce(_m.m, d.doc_id) AS component_id{kept} FROM documents d LEFT JOIN _n ON _n.doc_id = d.doc_id LEFT JOIN _m ON _m.d = d.doc_id"""
    )


_REPEATS_SQL = (
    "WITH "
    + _WORDS.format(text="text")
    + """,
_g AS (SELECT doc_id, pos, word, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g FROM _w),
_k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM _g WHERE pos <= n - 19),
_f AS (SELECT _g.doc_id, _g.pos, word, max(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY _g.doc_id ORDER BY _g.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM _g LEFT JOIN _k ON _k.doc_id = _g.doc_id AND _k.pos = _g.pos)
SELECT d.doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN _f ON _f.doc_id = d.doc_id GROUP BY d.doc_id"""
)

#: The others draw hashes, learn models or run tokenizers; tests/llm holds them against brute force, round trips or accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _near_sql(4, 80, ", coalesce(_m.m, d.doc_id) = d.doc_id AS kept"),
    "op4_suffix_tree_dedup": _REPEATS_SQL,
    "op11_conversation_trie": TRIE_SQL,
    "op12_conversation_repair": REPAIR_SQL,
    "op13_ngram_tree_join": _near_sql(3, 90),
}
