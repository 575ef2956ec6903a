"""Tables of a scale-factor folder, and the views of them that stand in for editions, alignment pairs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, par (1-based over what is left), text: normalised lines that are not empty."""
    return split_paragraphs(table(spark, sf_dir, "documents"))


def split_paragraphs(docs: DataFrame, pattern: str = r"\n[ \t]*") -> DataFrame:
    lines = F.filter(F.transform(F.split("text", pattern), X.fold_blanks), lambda t: t != "")
    return docs.select("doc_id", "lang", "source", F.posexplode(lines).alias("_p", "text")).select("doc_id", "lang", "source", (F.col("_p") + 1).alias("par"), "text")


def sentences(spark: SparkSession, sf_dir: str, rules: bool = True) -> DataFrame:
    """doc_id, lang, par, sent (1-based in the paragraph), text of the German and English documents."""
    return split_sentences(paragraphs(spark, sf_dir).where(F.col("lang").isin("de", "en")), rules)


def split_sentences(paras: DataFrame, rules: bool = True) -> DataFrame:
    pieces = F.when(F.col("lang") == "de", X.sentences_de(F.col("text"), rules)).otherwise(X.sentences_en(F.col("text"), rules))
    return paras.select("doc_id", "lang", "par", F.posexplode(pieces).alias("_s", "text")).select("doc_id", "lang", "par", (F.col("_s") + 1).alias("sent"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, toks: words and single signs of the lowered text."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", X.tokens(F.col("text")).alias("toks"))


def conversation_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side (src: user turns, dst: assistant turns), ord (0-based), turn, text; pairs with both sides only."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    both = W.partitionBy("conv_id")
    c = c.withColumn("_u", F.max((F.col("role") == "user").cast("int")).over(both)).withColumn("_a", F.max((F.col("role") == "assistant").cast("int")).over(both))
    side = F.when(F.col("role") == "user", "src").otherwise("dst")
    return c.where("_u = 1 and _a = 1").select(
        F.col("conv_id").alias("pair_id"),
        side.alias("side"),
        (F.row_number().over(W.partitionBy("conv_id", side).orderBy("turn")) - 1).alias("ord"),
        F.col("turn"),
        F.col("text"),
    )


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an event log: loop (user_id), line (event_id), event, value, ts, supersedes (of a correction)."""
    names = {"signup": "loop_start", "error": "failure", "purchase": "commit", "view": "test_run", "click": "correction"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("loop"),
        F.col("event_id").alias("line"),
        event.alias("event"),
        F.col("value"),
        F.col("ts"),
        F.when(event == "correction", F.col("event_id") - k).alias("supersedes"),
    )


# JSON lines of an event log made of the events: a file for each user, its first line a loop_start, some of their last ones a
# loop_end, and faults of each kind in some lines. Both engines read this text; what differs is passed in.
_LINE = """CASE WHEN event_id % 53 = 7 THEN concat('{{"v": "1.2", "broken', CAST(event_id AS {text}))
  WHEN event_id % 59 = 11 THEN '[1, 2]' WHEN event_id % 61 = 13 THEN '' ELSE
  concat('{{"v": ', CASE WHEN event_id % 4 = 0 THEN '"1.1"' WHEN event_id % 101 = 3 THEN '"x"' ELSE '"1.2"' END,
  ', "ts": "', CASE WHEN event_id % 89 = 5 THEN 'T0' ELSE concat('T', lpad(CAST(event_id AS {text}), 12, '0')) END, '"',
  CASE WHEN event_id % 67 = 17 THEN '' WHEN user_id % 13 = 4 AND event_id % 3 = 0 THEN ', "project": "other"' WHEN user_id % 17 = 6 THEN concat(', "project": "loop_', CAST(user_id AS {text}), '"') WHEN event_id % 103 = 9 THEN ', "project": 7' ELSE ', "project": "main"' END,
  ', "loop_id": "loop_', CAST(CASE WHEN event_id % 71 = 19 THEN user_id + 1 ELSE user_id END AS {text}), '", "event": "', CASE WHEN event_id % 73 = 23 THEN 'unheard' ELSE kind END, '", "data": ',
  CASE WHEN event_id % 79 = 29 THEN '"none"' ELSE
  CASE kind WHEN 'loop_start' THEN concat('{{"goal": "g', CAST(event_id AS {text}), '", "spec_refs": ', CASE WHEN event_id % 5 = 1 THEN '"A"' ELSE '["A", "B"]' END, ', "scaffold_version": "1", "agent": "x"}}')
  WHEN 'loop_end' THEN concat('{{"outcome": "', CASE WHEN event_id % 4 = 1 THEN 'odd' ELSE 'success' END, '", "failure_count": ', CAST(event_id % 9 AS {text}), ', "summary": "s"}}')
  WHEN 'failure' THEN concat('{{"code": "', CASE event_id % 7 WHEN 0 THEN 'SPEC-AMB' WHEN 1 THEN 'CTX-ROT' WHEN 2 THEN 'GEN-LOGIC' WHEN 3 THEN 'NEW-CODE' WHEN 4 THEN concat('X-', CAST(event_id AS {text})) ELSE 'TOOL-ENV' END, '", "severity": "S', CAST(event_id % 4 AS {text}),
    '", "detected_stage": ', CASE WHEN event_id % 6 = 2 THEN '1.5' WHEN event_id % 6 = 4 THEN 'true' ELSE '3' END, ', "summary": "s", "resolution": "', CASE event_id % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'harness_fix' ELSE 'hope' END, '"', CASE WHEN event_id % 8 = 3 THEN ', "harness_ref": "HC-1"' ELSE '' END, '}}')
  WHEN 'commit' THEN concat('{{"sha": ', CASE WHEN event_id % 5 = 2 THEN '72817' ELSE '"72817e6"' END, ', "kind": "', CASE WHEN event_id % 6 = 5 THEN 'style' ELSE 'fix' END, '"}}')
  WHEN 'test_run' THEN concat('{{"command": "c"', CASE WHEN event_id % 7 = 3 THEN '' ELSE ', "passed": 3' END, ', "failed": ', CASE WHEN event_id % 7 = 5 THEN 'null' ELSE '0' END, '}}')
  ELSE concat('{{"supersedes": ', CASE WHEN event_id % 11 = 4 THEN '"two"' ELSE CAST(line - 1 - k % 4 AS {text}) END, ', "reason": "r"}}') END END, '}}') END"""
_LINES = """SELECT concat('loop_', CAST(user_id AS {text})) AS file, line, event_id, {line} AS raw FROM (
  SELECT user_id, event_id, line, k, CASE WHEN line = 1 AND user_id % 11 <> 3 THEN 'loop_start' WHEN n - line = 3 + user_id % 3 AND user_id % 2 = 0 THEN 'loop_end'
    WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' THEN 'commit' WHEN event_type = 'view' THEN 'test_run' WHEN event_type = 'click' THEN 'correction' ELSE 'loop_start' END AS kind
  FROM (SELECT user_id, event_id, event_type, {k} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) a) b"""


def _lines_sql(text: str, k: str, events: str) -> str:
    return _LINES.format(text=text, k=k, events=events, line=_LINE.format(text=text))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, raw: the log that is there: each file but its last three lines."""
    return _log_parts(spark, sf_dir).where("_last > 3").select("file", "line", "raw")


def new_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, raw: each file's last three lines, as records that are to be appended; equal ones once."""
    return _log_parts(spark, sf_dir).where("_last <= 3 AND raw <> ''").select("file", "raw").distinct()


def _log_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = _lines_sql("STRING", "CAST(get_json_object(props, '$.k') AS BIGINT)", "<events>")
    rows = spark.sql(text.replace("{", "{{").replace("}", "}}").replace("<events>", "{events}"), events=events)
    return rows.withColumn("_last", F.row_number().over(W.partitionBy("file").orderBy(F.desc("line"))))


_DUCK_LINES = "_logged AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line DESC) AS back FROM (" + _lines_sql("VARCHAR", "CAST(json_extract_string(props, '$.k') AS BIGINT)", "events") + "))"
LOG_LINES_SQL = _DUCK_LINES + ", log_lines AS (SELECT file, line, raw FROM _logged WHERE back > 3)"
NEW_LINES_SQL = " new_lines AS (SELECT DISTINCT file, raw FROM _logged WHERE back <= 3 AND raw <> '')"

# DuckDB twins of the views above, for oracles: common table expressions to put behind WITH.
PARAGRAPHS_SQL = r"""
_lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
paragraphs AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS par, t AS text
  FROM (SELECT *, trim(regexp_replace(raw, '[ \t\r\n\f\v\x{A0}\x{2028}\x{2029}]+', ' ', 'g')) AS t FROM _lines) WHERE t <> '')"""
SENTENCES_SQL = PARAGRAPHS_SQL + r""",
_marked AS (SELECT doc_id, lang, par, text, CASE WHEN lang = 'de'
    THEN regexp_replace(text, '([.!?]«?) ([^\s\p{Ll}-])', '\1' || chr(30) || '\2', 'g')
    ELSE regexp_replace(text, '([.!?]+[”’]?) ([^\s\p{Ll}])', '\1' || chr(30) || '\2', 'g') END AS m FROM paragraphs WHERE lang IN ('de', 'en')),
sentences AS (SELECT doc_id, lang, par, unnest(string_split(m, chr(30))) AS text, generate_subscripts(string_split(m, chr(30)), 1) AS sent FROM _marked)"""
SIDES_SQL = """
_turns AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS u, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS a
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id)),
sides AS (SELECT conv_id AS pair_id, CASE WHEN role = 'user' THEN 'src' ELSE 'dst' END AS side,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ord, turn, text FROM _turns WHERE u = 1 AND a = 1)"""
LOG_SQL = """
log AS (SELECT user_id AS loop, event_id AS line,
  CASE event_type WHEN 'signup' THEN 'loop_start' WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'commit' WHEN 'view' THEN 'test_run' WHEN 'click' THEN 'correction' END AS event,
  value, ts, CASE WHEN event_type = 'click' THEN event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) END AS supersedes FROM events)"""

TOKENS_SQL = r"""
tokens AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_\p{Pc}]+|[^\p{L}\p{M}\p{N}_\p{Pc}\s]') AS toks FROM documents)"""
