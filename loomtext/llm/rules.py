"""Quality rules (8): document counts and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

The n-grams are two kinds over the whole text: every token, a run of letters and digits or of other signs, and every pair
of neighbouring tokens, hashed into buckets of their own kind. Two smoothed multinomials over the buckets, one of trusted
documents and one of the raw corpus, give each document a log-likelihood ratio, which is divided by the number of its
n-grams. The threshold is a quantile of the ratios of trusted documents that the target was not counted from (those that
it was counted from have higher ones). Every document is judged by the same threshold: nothing is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm.common import cut, label_column

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Buckets of each kind of n-gram.
BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Share of the trusted documents that the threshold may reject, and the step in which thresholds are told apart.
LOST = 0.005
STEP = 1e-3
#: One in so many trusted documents sets the threshold instead of making the target.
HELD = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def token_grams(text: Column, buckets: int) -> Column:
    """Buckets of all tokens, then of all pairs of neighbours."""

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        single = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda x, y: (F.pmod(F.xxhash64(x, y), F.lit(buckets)) + buckets).cast("int"))
        return F.concat(single, pairs)

    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"), F.lit(0))
    # An array of one, so that the hashes are made once.
    return F.get(F.transform(F.array(F.transform(tokens, lambda t: F.xxhash64(t))), grams), F.lit(0))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with an array: for each bucket, ln of its share in trusted documents over its share in all.

    docs: doc_id, text; trusted: doc_id, distinct. Counts are of all documents, pre-aggregated in each task.
    """
    # The trusted ids grow with the corpus, so they are never broadcast, however few they are.
    marked = docs.select("doc_id", "text").join(trusted.select(F.col("doc_id").alias("_t"), F.lit(1).alias("_one")).hint("merge"), F.col("doc_id") == F.col("_t"), "left")
    counts = (
        marked.select("_one", F.explode(token_grams(F.col("text"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.count("_one").alias("t"))
    )
    n_all = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("_bucket"))
    full = n_all.join(counts, F.col("_bucket") == F.col("bucket"), "left").select(
        F.col("_bucket").alias("bucket"),
        (F.col("_bucket") >= buckets).alias("kind"),
        (F.coalesce("n", F.lit(0)) + smoothing).alias("n"),
        (F.coalesce("t", F.lit(0)) + smoothing).alias("t"),
    )
    # Totals of the two kinds, over 2 x buckets rows.
    totals = full.groupBy("kind").agg(F.sum("n").alias("_n"), F.sum("t").alias("_t")).select(F.col("kind").alias("_kind"), "_n", "_t")
    ratio = full.join(F.broadcast(totals), F.col("kind") == F.col("_kind")).select("bucket", F.log(F.col("t") / F.col("_t") / (F.col("n") / F.col("_n"))).alias("ratio"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def quantile_threshold(scored: DataFrame, held: DataFrame, lost: float = LOST) -> DataFrame:
    """One row, threshold: the highest multiple of STEP below which at most that share of the held documents' llr lies.

    scored: doc_id, base_failed, llr; held: doc_id. Documents that fail the base rules don't count; null without any.
    """
    theirs = scored.where("not base_failed").join(held.select(F.col("doc_id").alias("_t")).hint("merge"), F.col("doc_id") == F.col("_t"), "left_semi")
    # At most as many rows as a mean log ratio has steps, some ten thousand.
    steps = theirs.groupBy(F.floor(F.col("llr") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.select("step", below.alias("_below"), F.sum("n").over(W.partitionBy()).alias("_all"))
    return ranked.agg((F.max(F.when(F.col("_below") <= F.col("_all") * lost, F.col("step"))) * STEP).alias("threshold"))


def judge(docs: DataFrame, trusted: DataFrame, held: DataFrame | None = None, buckets: int = BUCKETS, threshold: float | None = None, lost: float = LOST) -> DataFrame:
    """Judges every whole text of docs (doc_id, text). trusted: doc_id of the documents that the target is made of; held:
    doc_id of other trusted documents, of which the threshold on llr rejects the share `lost` at most, unless it is given.

    Returns doc_id, n_words; word_chars (code points in words), n_symbols (characters of SYMBOLS), n_dup_lines (lines
    with a word that equal an earlier one), n_repeat_words (words in windows of three that occur twice or more);
    base_failed (fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of them repeated); llr (mean log-likelihood
    ratio of an n-gram, 0 without any); kept (not base_failed and llr >= threshold; without held documents and threshold
    only the base rules count). A null text has no words. Rows that repeat a doc_id are judged each by itself, a null
    doc_id is judged but never trusted. Without trusted documents the target is uniform. Windows are compared by 64-bit
    hashes. Other columns are ignored.
    """
    ids = lambda x: x.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratios = log_ratios(plain, ids(trusted), buckets).scalar()
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    symbols = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s))) for s in SYMBOLS), F.lit(0))
    first = plain.select(
        "doc_id",
        words_of(F.col("text")).alias("_words"),
        lines.alias("_lines"),
        symbols.cast("long").alias("n_symbols"),
        token_grams(F.col("text"), buckets).alias("_grams"),
    )
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    second = first.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("_hashes"),
        "_grams",
    )
    n = F.size("_hashes")
    part = lambda a: F.slice("_hashes", F.lit(a), F.greatest(n - 2, F.lit(0)))
    windows = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.xxhash64(x, y)), part(3), lambda x, y: F.xxhash64(x, y))
    third = second.withColumn("_windows", F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).drop("_hashes")
    # Neighbours in the sorted windows that are equal: both begin at repeated words.
    size = F.size("_windows")
    earlier, later = F.slice("_windows", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("_windows", F.lit(2), F.greatest(size - 1, F.lit(0)))
    equal = F.filter(F.zip_with(earlier, later, lambda x, y: F.when(x["g"] == y["g"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    starts = F.array_distinct(F.flatten(equal))
    fourth = third.withColumn("_starts", starts).drop("_windows")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2)))))
    total = F.aggregate("_grams", F.lit(0.0), lambda t, g: t + F.get(F.col("_ratios"), g))
    fifth = fourth.withColumn("_ratios", ratios).withColumn("n_repeat_words", covered.cast("long")).withColumn(
        "llr", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")
    scored = fifth.withColumn("base_failed", failed).select(*columns)
    if threshold is not None or held is None:
        enough = F.lit(True) if threshold is None else F.col("llr") >= threshold
    else:
        scored = cut(scored)
        enough = F.coalesce(F.col("llr") >= quantile_threshold(scored, ids(held), lost).scalar(), F.lit(True))
    return scored.select(*columns, (~F.col("base_failed") & enough).alias("kept"))


def held_apart(trusted: DataFrame, one_in: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Two parts of doc_id by a hash: what makes the target, and one in so many to set the threshold with."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(one_in))
    return trusted.where(part != 0), trusted.where(part == 0)


def trusted_by_label(labels: DataFrame, name: str = "quality") -> DataFrame:
    """doc_id of the documents that labels mark as good."""
    return label_column(labels.sparkSession, labels, name).where("label = 1").select("doc_id")
