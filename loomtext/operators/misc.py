"""Position windows, numbers in texts, reading rows, figures, small neural demonstrations and file formats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.functions import text as X
from loomtext.operators.align import LINKS_SQL, links_by_method
from loomtext.operators.spans import term_spans
from loomtext.plans.registry import query
from loomtext.sources import formats
from loomtext.sources.sinks import bundle
from loomtext.sources.tables import PARAGRAPHS_SQL, SIDES_SQL, conversation_sides, paragraphs, table


def position_windows_of(sizes: DataFrame, width: int) -> DataFrame:
    """pair_id, n, m -> i0, j0, j1 of each window of `width` sources: the targets of the same relative positions."""
    cells = sizes.select("pair_id", "n", "m", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))).alias("i0"))
    at = lambda k: F.rint(k * F.col("m") / F.col("n")).cast("long")
    return cells.withColumn("j0", at(F.col("i0"))).select(
        "pair_id", F.col("i0").cast("long").alias("i0"), "j0", F.least(F.col("m"), F.greatest(at(F.least(F.col("i0") + width, F.col("n"))), F.col("j0") + 1)).cast("long").alias("j1")
    )


_WINDOWS_SQL = (
    "WITH "
    + SIDES_SQL
    + """, z AS (SELECT pair_id, count(*) FILTER (WHERE side = 'src') AS n, count(*) FILTER (WHERE side = 'dst') AS m FROM sides GROUP BY pair_id),
c AS (SELECT pair_id, n, m, unnest(range(greatest(n - 2, 0) + 1)) AS i0 FROM z), w AS (SELECT pair_id, n, m, i0, CAST(round_even(i0 * m / n, 0) AS BIGINT) AS j0 FROM c),
windows AS (SELECT pair_id, i0, j0, least(m, greatest(CAST(round_even(least(i0 + 2, n) * m / n, 0) AS BIGINT), j0 + 1)) AS j1 FROM w)"""
)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_sides(spark, sf_dir).groupBy("pair_id").agg(F.count_if(F.col("side") == "src").cast("int").alias("n"), F.count_if(F.col("side") == "dst").cast("int").alias("m"))


@query(_WINDOWS_SQL + " SELECT pair_id, i0, j0, j1 FROM windows")
def position_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_windows_of(_sizes(spark, sf_dir), 2)


@query(_WINDOWS_SQL + " SELECT w.pair_id, i0, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS owners FROM windows w JOIN sides s ON s.pair_id = w.pair_id AND s.side = 'dst' AND s.ord >= j0 AND s.ord < j1 GROUP BY ALL")
def window_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target side of each window: its characters and the positions that own them. Positions are expanded, so the join is by equality."""
    w = position_windows_of(_sizes(spark, sf_dir), 2).where("j1 > j0").select("pair_id", "i0", F.explode(F.sequence("j0", F.col("j1") - 1)).alias("ord"))
    s = conversation_sides(spark, sf_dir).where("side = 'dst'").select("pair_id", F.col("ord").cast("long").alias("ord"), "text")
    return w.join(s, ["pair_id", "ord"]).groupBy("pair_id", "i0").agg(
        F.sum(F.length("text")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("owners")
    )


# Idioms and numerals of German, with the forms of which a translation must have one, and beginnings of words
# that only look like numerals.
IDIOMS = {
    "halb sieben": ("六時半", "六時三十分", "六時 30 分"),
    "einviertel acht": ("七時十五分", "七時 15 分"),
    "dreiviertel": ("四十五分", "十五分前", "45 分"),
    "viertelstund": ("十五分", "四半時", "15 分"),
    "viertelstünd": ("十五分", "四半時", "15 分"),
    "Halbschlaf": ("まどろみ", "うたた寝", "半"),
    "halbverfault": ("半ば腐", "腐りかけ", "半"),
    "halblaut": ("小声", "半ば声", "低い声", "半"),
}
NUMERALS = {
    "zwei": ("二", "2", "ふた", "両"),
    "drei": ("三", "3", "み"),
    "vier": ("四", "4", "よ"),
    "fünf": ("五", "5", "いつ"),
    "sechs": ("六", "6", "む"),
    "sieben": ("七", "7", "なな"),
    "acht": ("八", "8", "や"),
    "neun": ("九", "9"),
    "zehn": ("十", "10"),
    "sechzehn": ("十六", "16"),
    "siebzehn": ("十七", "17"),
    "elf": ("十一", "11"),
    "zwölf": ("十二", "12"),
    "hundert": ("百", "100"),
    "tausend": ("千", "1000"),
    "halb": ("半", "半分", "なかば"),
    "Uhr": ("時", "時計"),
}
NOT_NUMBERS = ("achten", "achtete", "zweifel")


def spans_of_numbers(texts: DataFrame, terms: tuple[str, ...] = (*IDIOMS, *NUMERALS)) -> DataFrame:
    """id, text -> id, term, start, word: each place where a word begins with a term, and not with what only looks like one."""
    return term_spans(texts, terms, NOT_NUMBERS)


# The oracle's spans: every place of every term by its position; a longer term's place hides those that overlap it.
_NUMBER_SPANS_SQL = (
    "t(term) AS (VALUES "
    + ", ".join(f"('{t}')" for t in (*IDIOMS, *NUMERALS))
    + r"""), w AS (SELECT id, lower(src) AS x, unnest(range(1, length(src) + 1)) AS pos FROM n),
b AS (SELECT id, x, pos FROM w WHERE pos = 1 OR NOT regexp_matches(substr(x, pos - 1, 1), '[\p{L}\p{N}_]')),
p AS (SELECT b.id, t.term, pos, pos + length(t.term) + length(regexp_extract(substr(x, pos + length(t.term)), '^[\p{L}\p{N}_]*')) AS stop, substr(x, pos) AS tail FROM b JOIN t ON starts_with(substr(x, pos), lower(t.term))),
g AS (SELECT * FROM p WHERE """
    + " AND ".join(f"NOT starts_with(tail, '{w}')" for w in NOT_NUMBERS)
    + """),
s AS (SELECT id, term, pos - 1 AS start, substr(tail, 1, CAST(stop - pos AS INT)) AS word FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.id = g.id AND h.pos < g.stop AND g.pos < h.stop AND length(h.term) > length(g.term)))"""
)


_ANY_TERM = "|".join(t.lower() for t in (*IDIOMS, *NUMERALS))
_DOCUMENTS_SQL = f"n AS (SELECT doc_id AS id, text AS src FROM documents WHERE regexp_matches(lower(text), '{_ANY_TERM}'))"
_TURNS_SQL = "n AS (SELECT 1000 * u.conv_id + u.turn AS id, u.text AS src, a.text AS dst FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query("WITH " + _DOCUMENTS_SQL + ", " + _NUMBER_SPANS_SQL + " SELECT id, term, start, word FROM s")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the documents, with their places."""
    found = spans_of_numbers(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select("id", "term", F.col("start").cast("long").alias("start"), F.lower("word").alias("word"))


def missing_numbers(pairs: DataFrame) -> DataFrame:
    """id, src, dst -> id, term: numbers of the source of which the translation has no form."""
    forms = {**IDIOMS, **NUMERALS}
    ok = F.lit(False)
    for term, shapes in forms.items():
        ok |= (F.col("term") == term) & F.expr(" or ".join(f"contains(dst, '{f}')" for f in shapes))
    found = spans_of_numbers(pairs.select("id", F.col("src").alias("text"))).select("id", "term").distinct()
    return found.join(pairs.select(F.col("id").alias("_id"), "dst"), F.col("id") == F.col("_id")).where(~ok).select("id", "term")


@query(
    "WITH " + _TURNS_SQL + ", " + _NUMBER_SPANS_SQL + ", f(term, form) AS (VALUES " + ", ".join(f"('{t}', '{f}')" for t, fs in {**IDIOMS, **NUMERALS}.items() for f in fs) + ") "
    "SELECT DISTINCT s.id, s.term FROM s JOIN n ON n.id = s.id WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.term = s.term AND contains(n.dst, f.form))"
)
def audit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a user's turn of which the answer has no form."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("dst"))
    turns = c.where("role = 'user'").join(answers, ["conv_id", "turn"])
    return missing_numbers(turns.select((1000 * F.col("conv_id") + F.col("turn")).alias("id"), F.col("text").alias("src"), "dst"))


@query(
    "WITH RECURSIVE "
    + LINKS_SQL
    + """, d AS (SELECT pair_id, ord, CAST(floor(ord / 2) AS BIGINT) AS own FROM sides WHERE side = 'dst'), b AS (SELECT pair_id, j, min(ps) AS p FROM links WHERE method = 'length' GROUP BY ALL),
f AS (SELECT d.pair_id, d.ord, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY d.pair_id ORDER BY d.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS par FROM d LEFT JOIN b ON b.pair_id = d.pair_id AND b.j = d.ord),
s AS (SELECT pair_id, CAST(floor(ord / 2) AS BIGINT) AS par, ord FROM sides WHERE side = 'src')
SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.par, y.par) AS par, src, dst FROM (SELECT pair_id, par, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS src FROM s GROUP BY ALL) x
FULL OUTER JOIN (SELECT pair_id, par, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS dst FROM f GROUP BY ALL) y ON x.pair_id = y.pair_id AND x.par = y.par"""
)
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the source as rows, each position of either side once; unlinked targets follow the one before."""
    sides = conversation_sides(spark, sf_dir)
    best = links_by_method(spark, sf_dir).where("method = 'length'").groupBy("pair_id", "j").agg(F.min("ps").alias("p"))
    dst = sides.where("side = 'dst'").select("pair_id", F.col("ord").cast("long").alias("j")).join(best, ["pair_id", "j"], "left")
    order = W.partitionBy("pair_id").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    dst = dst.select("pair_id", F.lit("dst").alias("side"), F.coalesce(F.last("p", True).over(order), F.lit(0)).alias("par"), F.col("j").alias("ord"))
    src = sides.where("side = 'src'").select("pair_id", "side", F.floor(F.col("ord") / 2).cast("long").alias("par"), F.col("ord").cast("long").alias("ord"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",")
    return src.unionByName(dst).groupBy("pair_id", "par").pivot("side", ["src", "dst"]).agg(listed).select("pair_id", "par", F.nullif("src", F.lit("")).alias("src"), F.nullif("dst", F.lit("")).alias("dst"))


# Steps between ticks; above the last, hundreds.
STEPS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500)

def ticks(axes: DataFrame) -> DataFrame:
    """n, approx -> tick: about `approx` ticks on 0..n-1, at the first step that is wide enough, and the end."""
    raw = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest("approx", F.lit(1)) + 0.5)).cast("int")
    wide = F.filter(F.array(*map(F.lit, STEPS)), lambda x: x >= F.col("_raw"))
    step = F.when(F.size("_wide") > 0, F.get("_wide", F.lit(0))).otherwise((F.ceil(F.col("_raw") / 100) * 100).cast("int"))
    t = axes.withColumn("_raw", raw).withColumn("_wide", wide).withColumn("_step", step)
    marks = F.when(F.col("n") <= 1, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), F.col("n") - 1, F.col("_step")), F.array(F.col("n") - 1)))
    return t.select("n", "approx", F.explode(marks).alias("tick")).select("n", "approx", F.col("tick").cast("long").alias("tick"))


@query(
    "WITH a AS (SELECT DISTINCT CAST(length(coalesce(text, '')) AS INT) AS n, CAST(doc_id % 8 AS INT) AS approx FROM documents), r AS (SELECT *, CAST(greatest(1, floor(CAST(n AS DOUBLE) / greatest(approx, 1) + 0.5)) AS INT) AS raw FROM a), "
    "s AS (SELECT *, coalesce((SELECT min(x) FROM (VALUES " + ", ".join(f"({x})" for x in STEPS) + ") v(x) WHERE x >= raw), CAST(ceil(raw / 100.0) * 100 AS INT)) AS step FROM r) "
    "SELECT n, approx, CAST(t AS BIGINT) AS tick FROM (SELECT n, approx, unnest(range(0, n, step)) AS t FROM s UNION SELECT n, approx, greatest(n - 1, 0) FROM s)"
)
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks for axes as long as each document."""
    return ticks(table(spark, sf_dir, "documents").select(F.length(F.coalesce("text", F.lit(""))).alias("n"), (F.col("doc_id") % 8).cast("int").alias("approx")).distinct())


@query(
    "WITH RECURSIVE "
    + LINKS_SQL
    + " SELECT pair_id, string_agg((CASE WHEN k = 1 THEN 'M' ELSE 'L' END) || printf('%.1f', i * 10.0::DOUBLE) || ' ' || printf('%.1f', j * 5.0::DOUBLE), ' ' ORDER BY k) AS path FROM (SELECT pair_id, i, j, row_number() OVER (PARTITION BY pair_id ORDER BY i, j) AS k FROM links WHERE method = 'length') GROUP BY pair_id"
)
def svg_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each pair as the path of a figure."""
    points = F.array_sort(F.collect_list(F.struct("i", "j")))
    shown = F.transform("p", lambda x, k: F.concat(F.when(k == 0, "M").otherwise("L"), F.format_string("%.1f %.1f", x["i"] * 10.0, x["j"] * 5.0)))
    return links_by_method(spark, sf_dir).where("method = 'length'").groupBy("pair_id").agg(points.alias("p")).select("pair_id", F.array_join(shown, " ").alias("path"))


# Weights between the turns of a conversation (a window), in two layers, in place of attention between tokens; two turns are
# a sentence. Both engines read this.
_ATTENTION = """SELECT d.pair_id AS w, y.layer, d.ord AS t, s.ord AS s, CAST(floor(d.ord / 2) AS BIGINT) AS dst, CAST(floor(s.ord / 2) AS BIGINT) AS src,
CASE y.layer WHEN 0 THEN CAST(least(length(d.text), length(s.text)) AS DOUBLE) / greatest(length(d.text), length(s.text), 1) ELSE CAST(1 AS DOUBLE) / (1 + abs(d.ord - s.ord)) END AS x
FROM {sides} d JOIN {sides} s ON d.pair_id = s.pair_id AND d.side = 'dst' AND s.side = 'src' JOIN (SELECT 0 AS layer UNION ALL SELECT 1 AS layer) y ON 1 = 1"""
_ATTENTION_SQL = "WITH " + SIDES_SQL + ", a AS (" + _ATTENTION.format(sides="sides") + ")"


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ATTENTION, sides=conversation_sides(spark, sf_dir))


def fold_attention(tokens: DataFrame, *more: str) -> DataFrame:
    """Layers are averaged; weights sum over the source tokens of a sentence and average over the target tokens of one;
    a pair's score is the mean over the windows in which both occur."""
    mean = tokens.groupBy(*more, "w", "t", "s", "dst", "src").agg(F.avg("x").alias("x"))
    by_src = mean.groupBy(*more, "w", "t", "dst", "src").agg(F.sum("x").alias("x"))
    by_dst = by_src.groupBy(*more, "w", "dst", "src").agg(F.avg("x").alias("x"))
    return by_dst.groupBy(*more, "dst", "src").agg(F.round(F.avg("x"), 6).alias("score"))


@query(_ATTENTION_SQL + ", m AS (SELECT w, t, s, dst, src, avg(x) AS x FROM a GROUP BY ALL), b AS (SELECT w, t, dst, src, sum(x) AS x FROM m GROUP BY ALL), c AS (SELECT w, dst, src, avg(x) AS x FROM b GROUP BY ALL) SELECT dst, src, round(avg(x), 6) AS score FROM c GROUP BY ALL")
def attention_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_attention(attention(spark, sf_dir))


@query(_ATTENTION_SQL + ", b AS (SELECT layer, w, t, dst, src, sum(x) AS x FROM a GROUP BY ALL), c AS (SELECT layer, w, dst, src, avg(x) AS x FROM b GROUP BY ALL) SELECT layer, dst, src, round(avg(x), 6) AS score FROM c GROUP BY ALL")
def attention_fold_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_attention(attention(spark, sf_dir), "layer")


def encoder_layer(x: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """One post-norm transformer layer over (tokens, width)."""
    import math

    def norm(v: np.ndarray) -> np.ndarray:
        return (v - v.mean(-1, keepdims=True)) / np.sqrt(v.var(-1, keepdims=True) + 1e-12)

    n, d = x.shape
    split = lambda v: v.reshape(n, heads, d // heads).transpose(1, 0, 2)
    q, k, v = (split(x @ p[c]) for c in "qkv")
    scores = q @ k.transpose(0, 2, 1) / math.sqrt(d // heads) + np.where(mask > 0, 0, -1e4)
    weights = np.exp(scores - scores.max(-1, keepdims=True))
    weights /= weights.sum(-1, keepdims=True)
    x = norm(x + (weights @ v).transpose(1, 0, 2).reshape(n, d) @ p["o"])
    h = x @ p["up"]
    return norm(x + (h * 0.5 * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))) @ p["down"])


#: Tokens that the encoder takes at once, as many as the reference's.
PIECE = 128


@query()
def bert_forward_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small encoder with fixed random weights over all tokens (bytes) of each benchmark item, in pieces of PIECE, pooled over all."""

    def run(batches):
        rng = np.random.default_rng(3)
        table_ = rng.normal(0, 1, (256, 16))
        layers = [{c: rng.normal(0, 0.2, (16, 16)) for c in "qkvo"} | {"up": rng.normal(0, 0.2, (16, 32)), "down": rng.normal(0, 0.2, (32, 16))} for _ in range(2)]
        for b in batches:
            out = []
            for text in b["text"].fillna(""):
                ids = np.frombuffer(text.encode().ljust(1, b" "), np.uint8)
                total = np.zeros(16)
                for k in range(0, len(ids), PIECE):
                    x = table_[ids[k : k + PIECE]]
                    for p in layers:
                        x = encoder_layer(x, np.ones(len(x)), p, 4)
                    total += x.sum(0)
                out.append(total / len(ids))
            yield pd.DataFrame({"item_id": b["item_id"], "pooled": [v.tolist() for v in out]})

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, pooled array<double>")


@query(
    """WITH b AS (SELECT label, CAST(floor(vec_id / 512) AS BIGINT) AS block, count(*) AS n, max(len(embedding)) AS width FROM embeddings GROUP BY ALL)
SELECT label, block, 'embedding' AS name, 'F32' AS dtype, n || 'x' || width AS shape, n * width * 4 AS bytes FROM b UNION ALL SELECT label, block, 'vec_id', 'I64', CAST(n AS VARCHAR), n * 8 FROM b"""
)
def scan_safetensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of a safetensors file for each label and block of 512 ids: the vectors, and their ids."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        content = formats.write_safetensors({"embedding": np.array(rows["embedding"].tolist(), "<f4"), "vec_id": rows["vec_id"].to_numpy("<i8")})
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "block": [rows["block"].iloc[0]], "content": [content]})

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.floor(F.col("vec_id") / 512).alias("block"))
    files = vectors.groupBy("label", "block").applyInPandas(pack, "label long, block long, content binary")
    found = formats.explode_safetensors(files, "label", "block")
    return found.select("label", "block", "name", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, embedding[1] AS first FROM embeddings")
def vec_pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    back = formats.unpack_vectors(formats.pack_vectors(e), 64)
    return back.select("vec_id", F.size("embedding").cast("long").alias("width"), F.col("embedding")[0].alias("first"))


@query("WITH " + PARAGRAPHS_SQL + " SELECT doc_id, count(*) AS n FROM paragraphs GROUP BY doc_id")
def bundle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's paragraphs as a JSON array, counted after it is read back."""
    made = bundle(paragraphs(spark, sf_dir).select("doc_id", "par", "text"), ["doc_id"], "paragraphs")
    return made.select("doc_id", F.json_array_length("paragraphs").cast("long").alias("n"))


@query("WITH RECURSIVE " + LINKS_SQL + " SELECT method, count(*) AS links, count(DISTINCT pair_id) AS pairs FROM links GROUP BY method")
def links_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bundle(links_by_method(spark, sf_dir).select("method", "pair_id", "i", "j"), ["method", "pair_id"], "links")
    return made.groupBy("method").agg(F.sum(F.json_array_length("links")).alias("links"), F.count("*").alias("pairs"))


@query(
    r"""SELECT event_id, regexp_replace(chr(27) || '[32m' || CAST(event_id AS VARCHAR) || ' passed' || chr(27) || '[0m', '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g') AS plain,
printf('%.2f', value) || '%' AS share, format('{:,}', event_id * 1000) AS grouped, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS at FROM events"""
)
def formatted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal colours stripped, shares, grouped numbers and times as they are shown."""
    coloured = F.concat(F.lit("\x1b[32m"), F.col("event_id").cast("string"), F.lit(" passed\x1b[0m"))
    return table(spark, sf_dir, "events").select(
        "event_id", X.strip_ansi(coloured).alias("plain"), X.percent(F.col("value") / 100, 2).alias("share"), X.thousands(F.col("event_id") * 1000).alias("grouped"), X.iso_time(F.col("ts")).alias("at")
    )
