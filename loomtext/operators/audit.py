"""Audits of a translation against its source, of a ledger, and of texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.plans.registry import query
from loomtext.plans.shared import shared, shared_all
from loomtext.sources.scratch import global_rank
from loomtext.sources.tables import PARAGRAPHS_SQL, SIDES_SQL, conversation_sides, paragraphs

class Term(NamedTuple):
    """A glossary entry: forms of which a translation must have one; whole: found as a word only, not as a word's beginning."""

    term: str
    kind: str
    forms: tuple[str, ...]
    whole: bool = False


# A glossary over the invented prose of the driver's tables; a user passes one's own.
GLOSSARY = (Term("the", "name", ("the", "der", "die"), True), Term("and", "name", ("und", "et", "and")), Term("with", "term", ("for", "mit")), Term("wat", "term", ("was", "water")), Term("der", "term", ("le",), True))
#: src, dst: turns of a conversation, joined by position, stand for a paragraph and its translation.
PAIRED = "(SELECT s.pair_id, s.ord, s.text AS src, d.text AS dst FROM {sides} s JOIN {sides} d ON s.pair_id = d.pair_id AND s.ord = d.ord WHERE s.side = 'src' AND d.side = 'dst')"


def hits(text: Column, glossary: tuple[Term, ...] = GLOSSARY) -> Column:
    """term, n: how often each term of the glossary that a text has occurs in it. One scan; the glossary is no table."""
    counts = [F.struct(F.lit(t.term).alias("term"), F.regexp_count(text, F.lit(X.term_pattern(t.term, t.whole))).cast("long").alias("n")) for t in glossary]
    return F.filter(F.array(*counts), lambda x: x["n"] > 0)


def missing_terms(pairs: DataFrame, kind: str, glossary: tuple[Term, ...] = GLOSSARY) -> DataFrame:
    """pair_id, ord, src, dst -> pair_id, ord, term: terms of the source of which the translation has no form."""
    checks = [F.when(F.col("src").rlike(X.term_pattern(t.term, t.whole)) & ~F.exists(F.array(*map(F.lit, t.forms)), lambda f: F.contains("dst", f)), F.lit(t.term)) for t in glossary if t.kind == kind]
    return pairs.select("pair_id", "ord", F.explode(F.array_compact(F.array(*checks))).alias("term"))


def registry(paras: DataFrame, glossary: tuple[Term, ...] = GLOSSARY) -> DataFrame:
    """doc_id, par, term, n of each paragraph and each term that it has."""
    return paras.select("doc_id", "par", F.explode(hits(F.col("text"), glossary)).alias("h")).select("doc_id", "par", "h.term", "h.n")


# The oracle's patterns: RE2 has no look-around, so that the sign before a word is part of the match.
_LETTER = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def _duck_pattern(t: Term) -> str:
    return rf"(?:^|[^{_LETTER[1:-1]}]){t.term}" + (rf"(?:[^{_LETTER[1:-1]}]|$)" if t.whole else f"{_LETTER}*")


_TERMS_SQL = "g(term, kind, whole, pattern, forms) AS (VALUES " + ", ".join(f"('{t.term}', '{t.kind}', {t.whole}, '{_duck_pattern(t)}', {list(t.forms)})" for t in GLOSSARY) + ")"
# A paragraph's words are counted, each against all terms: the oracle splits where the query searches.
_REGISTRY_SQL = (
    "WITH " + PARAGRAPHS_SQL + ", " + _TERMS_SQL + ", _v AS (SELECT doc_id, par, unnest(regexp_extract_all(text, '" + _LETTER + "+')) AS w FROM paragraphs), "
    "r AS (SELECT doc_id, par, term, count(*) AS n FROM _v JOIN g ON CASE WHEN whole THEN w = term ELSE starts_with(w, term) END GROUP BY ALL)"
)
_MISSING_SQL = "WITH " + SIDES_SQL + ", " + _TERMS_SQL + " SELECT p.pair_id, p.ord, g.term FROM " + PAIRED.format(sides="sides") + " p JOIN g ON regexp_matches(p.src, g.pattern) WHERE g.kind = '{kind}' AND NOT list_bool_or(list_transform(g.forms, lambda f: contains(p.dst, f)))"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + PAIRED, sides=conversation_sides(spark, sf_dir))


@query(_MISSING_SQL.replace("{kind}", "name"))
def audit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_terms(paired(spark, sf_dir), "name")


@query(_MISSING_SQL.replace("{kind}", "term"))
def audit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_terms(paired(spark, sf_dir), "term")


@query(_REGISTRY_SQL + " SELECT term, count(*) AS n FROM r GROUP BY term")
def term_paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(paragraphs(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(_REGISTRY_SQL + " SELECT term, CAST(sum(n) AS BIGINT) AS hits, min(doc_id) AS first_doc FROM r GROUP BY term")
def registry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(paragraphs(spark, sf_dir)).groupBy("term").agg(F.sum("n").alias("hits"), F.min("doc_id").alias("first_doc"))


@query(_REGISTRY_SQL + " SELECT (SELECT count(*) FROM paragraphs) AS total, (SELECT count(*) FROM (SELECT DISTINCT doc_id, par FROM r)) AS hits")
def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_of = F.col("text").rlike("|".join(X.term_pattern(t.term, t.whole) for t in GLOSSARY))
    return paragraphs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(any_of).alias("hits"))


@query(_REGISTRY_SQL + " SELECT g.term, g.kind, x.doc_id, x.par FROM g LEFT JOIN (SELECT term, doc_id, par FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, par) AS k FROM r) WHERE k = 1) x ON x.term = g.term")
def word_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term with the first paragraph that has it."""
    first = registry(paragraphs(spark, sf_dir)).groupBy(F.col("term").alias("_t")).agg(F.min(F.struct("doc_id", "par")).alias("at"))
    terms = spark.createDataFrame([(t.term, t.kind) for t in GLOSSARY], "term string, kind string")
    return terms.join(first, F.col("term") == F.col("_t"), "left").select("term", "kind", "at.doc_id", "at.par")


AUDITS = {
    "audit_paragraphs": "SELECT d.pair_id, d.ord, 'unknown' AS problem FROM {sides} d LEFT ANTI JOIN (SELECT pair_id, ord FROM {sides} WHERE side = 'src') s ON s.pair_id = d.pair_id AND s.ord = d.ord WHERE d.side = 'dst' "
    "UNION ALL SELECT pair_id, ord, 'empty' FROM {sides} WHERE side = 'dst' AND trim(text) = '' "
    "UNION ALL SELECT s.pair_id, s.ord, 'missing' FROM {sides} s LEFT ANTI JOIN (SELECT pair_id, ord FROM {sides} WHERE side = 'dst') d ON s.pair_id = d.pair_id AND s.ord = d.ord WHERE s.side = 'src'",
    "audit_rights": "SELECT k, 'extra' AS problem FROM (SELECT s_nationkey AS k FROM {supplier} GROUP BY s_nationkey) a WHERE k NOT IN (SELECT n_nationkey FROM {nation} WHERE n_nationkey < 20) "
    "UNION ALL SELECT n_nationkey, 'empty field' FROM {nation} WHERE coalesce(n_name, '') = ''",
    "manifest": "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM {documents} GROUP BY lang",
}



@query(
    "WITH "
    + SIDES_SQL
    + ", r AS (SELECT pair_id, ord, CAST(length(dst) AS DOUBLE) / length(src) AS ratio FROM "
    + PAIRED.format(sides="sides")
    + " p WHERE length(src) > 0), k AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS k, count(*) OVER () AS n FROM r), m AS (SELECT ratio AS mid, n FROM k WHERE k = n // 2) SELECT pair_id, ord FROM r, m WHERE n >= 5 AND (ratio < 0.6 * mid OR ratio > 1.6 * mid)"
)
def audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose ratio of lengths leaves a band around the upper median of all; none where there are fewer than five."""
    rows = paired(spark, sf_dir).where("length(src) > 0").select("pair_id", "ord", (F.length("dst").cast("double") / F.length("src")).alias("ratio"))
    return outside_band(rows, 0.6, 1.6)


def outside_band(rows: DataFrame, low: float, high: float, least: int = 5) -> DataFrame:
    """pair_id, ord of the rows (pair_id, ord, ratio) below low or above high times the upper median; none of fewer than least."""
    ranked = global_rank(rows, ["ratio"])
    mid = ranked.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    at = ranked.join(F.broadcast(mid), F.col("rank") == F.floor(F.col("_n") / 2)).where(F.col("_n") >= least).select(F.col("ratio").alias("_mid"))
    return ranked.join(F.broadcast(at), (F.col("ratio") < low * F.col("_mid")) | (F.col("ratio") > high * F.col("_mid"))).select("pair_id", "ord")


for _name, _sql in AUDITS.items():
    shared(_name, _sql, _sql.replace("LEFT ANTI JOIN", "ANTI JOIN"))

# Terms that are no word of any passage; within a word they don't count.
_EDGE = r"[^\pL\pM\pN_]"
_UNTOUCHED = "SELECT term FROM (VALUES ('the'), ('th'), ('and'), ('zzz-none'), ('qqq')) AS g(term) WHERE NOT EXISTS (SELECT 1 FROM {benchmark} b WHERE <match>)"
shared(
    "registry_untouched",
    _UNTOUCHED.replace("<match>", f"b.text RLIKE concat('(^|{_EDGE})', g.term, '({_EDGE}|$)')".replace("\\", "\\\\")),
    _UNTOUCHED.replace("<match>", f"regexp_matches(b.text, concat('(^|{_EDGE})', g.term, '({_EDGE}|$)'))"),
)

_BAD_SIGNS = "[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1FЀ-ԯ가-힣ᄀ-ᇿ㄰-㆏]"
# Lines of pages with signs of scripts that don't belong there, put in where an address has a certain rest.
_LINES = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(html, 'при') WHEN 1 THEN concat(html, '한국 allow-script') WHEN 2 THEN concat(html, chr(7)) WHEN 3 THEN concat(html, '한') ELSE html END AS t FROM {pages}"
shared_all(
    {
        "text_hygiene": (
            "SELECT page_id, CASE WHEN t RLIKE '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]' THEN 'control' WHEN t RLIKE '[Ѐ-ԯ]' THEN 'cyrillic' ELSE 'hangul' END AS problem FROM (" + _LINES + ") x WHERE t RLIKE '" + _BAD_SIGNS + "' AND t NOT LIKE '%allow-script%'",
            "SELECT page_id, CASE WHEN regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control' WHEN regexp_matches(t, '[Ѐ-ԯ]') THEN 'cyrillic' ELSE 'hangul' END AS problem FROM (" + _LINES + ") x WHERE regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1FЀ-ԯ가-힣ᄀ-ᇿ㄰-㆏]') AND t NOT LIKE '%allow-script%'",
        ),
        "glob_exempt": (
            "SELECT page_id, url RLIKE '^.*/en/.*$' OR url RLIKE '^https://blog[.].*$' AS exempt FROM {pages}",
            "SELECT page_id, (url GLOB '*/en/*') OR (url GLOB 'https://blog.*') AS exempt FROM {pages}",
        ),
        # Key and value at the first sign of equality.
        "parse_kv": (
            "SELECT event_id, split(kv, '=', 2)[0] AS k, split(kv, '=', 2)[1] AS v FROM (SELECT event_id, concat(event_type, '=', props, '=', event_type) AS kv FROM {events}) x",
            "SELECT event_id, split_part(kv, '=', 1) AS k, substr(kv, instr(kv, '=') + 1) AS v FROM (SELECT event_id, concat(event_type, '=', props, '=', event_type) AS kv FROM {events}) x",
        ),
        # Lines of a document between blank ones, of which its sources are made up.
        "block_records": (
            "WITH raw AS (SELECT doc_id, posexplode(split(concat(text, '\\n\\n', source, '\\n', lang), '\\n')) AS (p, l) FROM {documents} WHERE text IS NOT NULL), b AS (SELECT *, sum(CASE WHEN l = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS block FROM raw) "
            "SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n, min_by(l, p) AS first, max_by(l, p) AS last FROM b WHERE l <> '' GROUP BY doc_id, block",
            "WITH x AS (SELECT doc_id, string_split(concat(text, chr(10), chr(10), source, chr(10), lang), chr(10)) AS a FROM {documents} WHERE text IS NOT NULL), raw AS (SELECT doc_id, unnest(range(len(a))) AS p, unnest(a) AS l FROM x), "
            "b AS (SELECT *, sum(CASE WHEN l = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS block FROM raw) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n, arg_min(l, p) AS first, arg_max(l, p) AS last FROM b WHERE l <> '' GROUP BY doc_id, block",
        ),
    }
)
