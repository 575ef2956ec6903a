"""Text segmentation: from raw texts to chapters, paragraphs, sentences and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.functions import text as X
from loomtext.plans.registry import query
from loomtext.sources.tables import PARAGRAPHS_SQL, SENTENCES_SQL, paragraphs, sentences, table

# Books made of the documents, for what the tables lack: markers and chapter headings. Lines of text begin with a mark, so
# that none is a heading. Both engines read this.
_BOOKS = """SELECT doc_id AS book, concat('front', chr(10), '*** START OF ', CAST(doc_id AS {text}), ' ***', chr(10), chr(10), 'I.', chr(10), '> ', replace(coalesce(text, ''), chr(10), concat(chr(10), '> ')), chr(10),
'II', chr(10), coalesce(source, ''), chr(10), CASE WHEN doc_id % 2 = 0 THEN 'III.' ELSE 'III' END, chr(10), coalesce(lang, ''), chr(10), '*** END OF THE BOOK ***', chr(10), 'back') AS raw FROM {documents}"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BOOKS.format(text="STRING", documents="{documents}"), documents=table(spark, sf_dir, "documents"))


def strip_wrapper(raw: DataFrame) -> DataFrame:
    """raw and other columns -> these and body: what stands strictly between the START and END marker lines; without both,
    in order, an error."""
    body = F.regexp_extract("raw", r"(?ms)^\*\*\* START[^\n]*\n(.*?)^\*\*\* END", 1)
    bad = ~F.col("raw").rlike(r"(?ms)^\*\*\* START[^\n]*\n.*?^\*\*\* END")
    return raw.select(*[c for c in raw.columns if c != "raw"], F.when(bad, F.raise_error(F.lit("no START and END markers in order"))).otherwise(body).alias("body"))


def split_chapters(books: DataFrame, headings: tuple[str, ...] = ("I", "II", "III")) -> DataFrame:
    """book, body -> book, chapter (from 1), heading, text: lines that are a heading alone (a stop may follow) begin a chapter.

    A book has all headings, each once and in their order; else it is an error. What stands before the first is left out.
    A book is split in the row that it is, so books never meet.
    """
    lines = F.split("body", "\n")
    named = F.transform(lines, lambda x: F.regexp_extract(F.trim(x), "^(" + "|".join(headings) + r")\.?$", 1))
    marks = F.filter(F.transform(named, lambda h, i: F.struct(h.alias("heading"), i.alias("at"))), lambda x: x["heading"] != "")
    found = books.select("book", lines.alias("lines"), marks.alias("marks"))
    names = F.transform("marks", lambda x: x["heading"])
    wanted = F.array(*map(F.lit, headings))
    problem = F.concat(F.lit("the headings of a book are "), F.array_join(names, ","), F.lit(", not " + ",".join(headings)))
    checked = found.withColumn("marks", F.when(names == wanted, F.col("marks")).otherwise(F.raise_error(problem)))
    begins = F.transform("marks", lambda x: x["at"])
    ends = F.concat(F.slice(begins, F.lit(2), F.lit(len(headings))), F.array(F.size("lines")))
    parts = F.zip_with("marks", ends, lambda m, e: F.struct(m["heading"].alias("heading"), F.array_join(F.slice("lines", m["at"] + 2, F.greatest(e - m["at"] - 1, F.lit(0))), "\n").alias("text")))
    return checked.select("book", F.posexplode(parts).alias("_k", "_c")).select("book", (F.col("_k") + 1).cast("long").alias("chapter"), "_c.heading", "_c.text")


_BODY = r"regexp_extract(raw, '(?ms)^\*\*\* START[^\n]*\n(.*?)^\*\*\* END', 1)"
_DUCK_BOOKS = _BOOKS.format(text="VARCHAR", documents="documents")


@query(f"WITH b AS ({_DUCK_BOOKS}) SELECT book, md5({_BODY}) AS digest FROM b")
def strip_wrapper_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_wrapper(books(spark, sf_dir)).select("book", F.md5("body").alias("digest"))


_CHAPTERS_SQL = f"""WITH r AS ({_DUCK_BOOKS}), b AS (SELECT book, {_BODY} AS body FROM r),
l AS (SELECT book, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM b),
m AS (SELECT *, regexp_extract(trim(text), '^(I|II|III)\\.?$', 1) AS h FROM l),
c AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY line) AS chapter FROM m)
SELECT book, CAST(chapter AS BIGINT) AS chapter, max(h) AS heading, md5(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE h = '')) AS digest FROM c WHERE chapter > 0 GROUP BY book, chapter"""


@query(_CHAPTERS_SQL)
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chapters(strip_wrapper(books(spark, sf_dir))).select("book", "chapter", "heading", F.md5("text").alias("digest"))


@query(
    PARAGRAPHS_SQL.replace("\n_lines", "WITH _lines", 1)
    + """, m AS (SELECT doc_id, par, text, CASE WHEN length(text) < 12 THEN 1 ELSE 0 END AS h FROM paragraphs),
c AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY par) AS chapter FROM m)
SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, max(CASE WHEN h = 1 THEN text END) AS heading, count(*) FILTER (WHERE h = 0) AS n_paragraphs FROM c WHERE chapter > 0 GROUP BY ALL"""
)
def chapter_split_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters begun by short lines, which stand in for ordinal headings."""
    p = paragraphs(spark, sf_dir).withColumn("_h", (F.length("text") < 12).cast("int"))
    p = p.withColumn("chapter", F.sum("_h").over(W.partitionBy("doc_id").orderBy("par")))
    return p.where("chapter > 0").groupBy("doc_id", "chapter").agg(F.max(F.when(F.col("_h") == 1, F.col("text"))).alias("heading"), F.count_if(F.col("_h") == 0).alias("n_paragraphs"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '[ \t\r\n\f\v\x{A0}]+', ' ', 'g')) AS title,
  CAST(length(a) - length(replace(a, '<p>', 'p>')) AS BIGINT) AS n_sections FROM a"""
)
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page: its heading and how many paragraphs it has."""
    a = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    title = X.strip_markup(F.regexp_extract(a, r"(?s)<h1>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_count(a, F.lit("<p>")).cast("long").alias("n_sections"))


@query("WITH " + PARAGRAPHS_SQL + " SELECT doc_id, par, text FROM paragraphs")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("doc_id", "par", "text")


@query("WITH " + PARAGRAPHS_SQL + " SELECT doc_id, par - 1 AS par, text FROM paragraphs WHERE par > 1")
def drop_title_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).where("par > 1").select("doc_id", (F.col("par") - 1).alias("par"), "text")


@query("WITH " + PARAGRAPHS_SQL + " SELECT printf('%s-%d-%03d', source, 1, par) AS pid, doc_id, par, length(text) AS chars FROM paragraphs")
def build_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select(F.format_string("%s-%d-%03d", "source", F.lit(1), "par").alias("pid"), "doc_id", "par", F.length("text").cast("long").alias("chars"))


@query("WITH " + SENTENCES_SQL + " SELECT doc_id, par, sent, text FROM sentences WHERE lang = 'de'")
def sentences_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).where("lang = 'de'").select("doc_id", "par", "sent", "text")


@query("WITH " + SENTENCES_SQL + " SELECT doc_id, par, sent, text FROM sentences WHERE lang = 'en'")
def sentences_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).where("lang = 'en'").select("doc_id", "par", "sent", "text")


@query(
    PARAGRAPHS_SQL.replace("\n_lines", "WITH _lines", 1)
    + """, _m AS (SELECT doc_id, par, string_split(regexp_replace(translate(text, '.!?', '。！？'), '([。！？])', '\\1' || chr(30), 'g'), chr(30)) AS p FROM paragraphs),
_s AS (SELECT doc_id, par, list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '') AS p FROM _m) SELECT doc_id, par, generate_subscripts(p, 1) AS sent, unnest(p) AS text FROM _s"""
)
def sentences_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with Japanese stops in place of their own; tests/test_texts.py has the rules about brackets."""
    p = paragraphs(spark, sf_dir).select("doc_id", "par", F.translate("text", ".!?", "。！？").alias("text"))
    return p.select("doc_id", "par", F.posexplode(X.sentences_ja(F.col("text"))).alias("_s", "text")).select("doc_id", "par", (F.col("_s") + 1).cast("long").alias("sent"), "text")


@query(
    "WITH "
    + SENTENCES_SQL
    + """ SELECT doc_id, par, sent, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, par ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, par ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS "end" FROM sentences"""
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open code-point spans in the folded paragraph, where one blank stands between sentences."""
    before = W.partitionBy("doc_id", "par").orderBy("sent").rowsBetween(W.unboundedPreceding, -1)
    s = sentences(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))
    return s.select("doc_id", "par", "sent", "start", (F.col("start") + F.length("text")).cast("long").alias("end"))


@query(
    "WITH "
    + SENTENCES_SQL
    + """ SELECT s.doc_id, s.par, string_agg(replace(s.text, ' ', ''), '' ORDER BY s.sent) = max(replace(p.text, ' ', '')) AS lossless
FROM sentences s JOIN paragraphs p ON s.doc_id = p.doc_id AND s.par = p.par GROUP BY ALL"""
)
def sentence_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sentences of a paragraph have all that it has but blanks."""
    p = paragraphs(spark, sf_dir).where(F.col("lang").isin("de", "en"))
    parts = F.when(F.col("lang") == "de", X.sentences_de(F.col("text"))).otherwise(X.sentences_en(F.col("text")))
    bare = lambda t: F.regexp_replace(t, r"\s", "")
    return p.select("doc_id", "par", (bare(F.array_join(parts, "")) == bare(F.col("text"))).alias("lossless"))


@query(
    "WITH "
    + SENTENCES_SQL
    + r""", _free AS (SELECT lang, len(string_split(CASE WHEN lang = 'de' THEN regexp_replace(text, '([.!?]«?) (\S)', '\1' || chr(30) || '\2', 'g')
  ELSE regexp_replace(text, '([.!?]+[”’]?) ([^\s\p{Ll}])', '\1' || chr(30) || '\2', 'g') END, chr(30))) AS n FROM paragraphs WHERE lang IN ('de', 'en')),
w AS (SELECT lang, count(*) AS with_rules FROM sentences GROUP BY lang), f AS (SELECT lang, CAST(sum(n) AS BIGINT) AS without_rules FROM _free GROUP BY lang)
SELECT w.lang, with_rules, without_rules FROM w JOIN f ON w.lang = f.lang"""
)
def sentence_rule_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each language with and without the rules."""
    with_ = sentences(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("with_rules"))
    return with_.join(sentences(spark, sf_dir, rules=False).groupBy("lang").agg(F.count("*").alias("without_rules")), "lang")


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_\p{Pc}]+|[^\p{L}\p{M}\p{N}_\p{Pc}\s]') AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_distinct FROM t"""
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_RUBY = "<ruby><rb>{a}</rb><rt>{b}</rt></ruby>"


@query(
    "WITH h AS (SELECT doc_id, regexp_replace(text, '([\\p{L}]+) ([\\p{L}]+)', '" + _RUBY.format(a="\\1", b="\\2") + "', 'g') AS html FROM documents), "
    "b AS (SELECT doc_id, regexp_extract_all(html, '" + _RUBY.format(a="(.*?)", b="(.*?)") + "', 1) AS x, regexp_extract_all(html, '" + _RUBY.format(a="(.*?)", b="(.*?)") + "', 2) AS y FROM h) "
    "SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS base, unnest(y) AS reading FROM b"
)
def ruby_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and reading of each ruby; the documents' neighbouring words stand in for them."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"([\p{L}]+) ([\p{L}]+)", _RUBY.format(a="$1", b="$2")).alias("html"))
    pattern = F.lit(_RUBY.format(a="(.*?)", b="(.*?)"))
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("base"), F.regexp_extract_all("html", pattern, 2).alias("reading"))
    return raw.select("doc_id", F.posexplode(pairs).alias("_p", "x")).select("doc_id", (F.col("_p") + 1).cast("long").alias("pos"), F.col("x.base").alias("base"), F.col("x.reading").alias("reading"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[ \t\r\n\f\v\x{A0}\x{2028}\x{2029}]+', ' ', 'g')) AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \t\r\n\f\v\x{A0}\x{2028}\x{2029}]+', ' ', 'g')) AS text FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))
