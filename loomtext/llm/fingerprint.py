"""Document fingerprints (3): improved consistent weighted sampling, in DataFrame functions alone.

For sample k and term x of weight w, r and c are Gamma(2, 1) and b is uniform, all drawn from hashes of (x, k):
    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r,
and the sample is the term of least a with its t. Two texts share a sample with the probability of their generalised
Jaccard similarity, sum of min(w) / sum of max(w). As a depends on (x, k, t) only, equal samples are equal values of
ln a and the least value itself names the sample: a sample needs one minimum of doubles, which Spark aggregates in
generated code.

A term is the 64-bit hash of its word, so distinct words stay distinct. Two more hashes of it and k give the five uniforms
of a sample: 25 bits for each of those that r and c take, 28 for b.

A text and its edited text share most terms, with equal weights. Such a term is drawn for once and counts for both: terms
fall into those of the text, those of the edited text and those of both, and a signature is the lesser of two minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm.common import cut

SAMPLES = 64
#: Bytes of a sample in the fingerprint: different samples look alike with a probability of 2^-16.
SAMPLE_BYTES = 2
BLANKS = " \t\n\x0b\x0c\r"
SMALLEST = -(2**63)


def _uniform(bits: Column, n: int) -> Column:
    """In (0, 1), from n bits."""
    return (bits.cast("double") + 0.5) / float(1 << n)


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of sample k of a term (long); null where log_weight is."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    mask = F.lit((1 << 25) - 1)
    gamma = lambda h: -F.log(_uniform(h.bitwiseAND(mask), 25) * _uniform(F.shiftrightunsigned(h, 25).bitwiseAND(mask), 25))
    r, c = gamma(one), gamma(two)
    b = _uniform(F.shiftleft(F.shiftrightunsigned(one, 50), 14) + F.shiftrightunsigned(two, 50), 28)
    return F.log(c) - r * (F.floor(log_weight / r + b).cast("double") - b) - r


def neighbours(keys: DataFrame) -> DataFrame:
    """_d, _h, n -> copies (rows that have the pair), _nd, _nh: the next pair in ascending order, after the last the first;
    _pd, _ph, _pn: the one before and its n.

    A range partitioning orders the pairs over tasks; a pair's rank is its place in its task after the sizes of the
    tasks before, of which there is one row for each task. Places are written before they are used, as ranges are sampled.
    """
    ordered = keys.groupBy("_d", "_h").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")).repartitionByRange("_d", "_h").sortWithinPartitions("_d", "_h")
    placed = cut(ordered.withColumn("_m", F.monotonically_increasing_id())).select(
        "_d", "_h", "copies", "n", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")
    )
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        F.col("_p").alias("_q"),
        F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias("_all"),
    )
    ranked = placed.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn("_r", F.col("_before") + F.col("_i"))
    ahead = ranked.select(F.col("_d").alias("_nd"), F.col("_h").alias("_nh"), F.pmod(F.col("_r") - 1, F.col("_all")).alias("_ra"))
    behind = ranked.select(F.col("_d").alias("_pd"), F.col("_h").alias("_ph"), F.col("n").alias("_pn"), F.pmod(F.col("_r") + 1, F.col("_all")).alias("_rb"))
    return ranked.join(ahead, F.col("_r") == F.col("_ra")).join(behind, F.col("_r") == F.col("_rb")).select("_d", "_h", "n", "copies", "_nd", "_nh", "_pd", "_ph", "_pn")


def signatures(pairs: DataFrame, key: list[str], one: str, other: str, samples: int) -> DataFrame:
    """key, signature_one and signature_other of two text columns of pairs; null for a text without words.

    pairs must be partitioned by key: then none of the aggregations moves rows.
    """
    texts = F.array(F.struct(F.lit(True).alias("own"), F.col(one).alias("text")), F.struct(F.lit(False).alias("own"), F.col(other).alias("text")))
    words = (
        pairs.select(*key, F.inline(texts))
        .select(*key, "own", F.explode(F.split(F.btrim("text", F.lit(BLANKS)), r"[\x20\x09-\x0D]+")).alias("word"))
        .where("word <> ''")
    )
    terms = words.select(*key, F.xxhash64("word").alias("term"), F.col("own").cast("long").alias("own")).groupBy(*key, "term").agg(F.sum("own").alias("w1"), F.sum(1 - F.col("own")).alias("w2"))
    # 0: in both, as often; 1: in one; 2: in the other. A term that is in both at different weights is drawn for twice.
    kinds = F.when(F.col("w1") == F.col("w2"), F.array(F.struct(F.lit(0).alias("kind"), F.col("w1").alias("weight")))).otherwise(
        F.array(F.struct(F.lit(1).alias("kind"), F.col("w1").alias("weight")), F.struct(F.lit(2).alias("kind"), F.col("w2").alias("weight")))
    )
    weighted = terms.select(*key, "term", F.inline(kinds)).where("weight > 0").select(*key, "kind", "term", F.log(F.col("weight").cast("double")).alias("log_weight"))
    minima = weighted.groupBy(*key, "kind").agg(*[F.min(sample_value(F.col("term"), F.col("log_weight"), k)).alias(f"a{k}") for k in range(samples)])
    # Three rows at most for each text; as text, as bytes of a hash of the least value.
    values = minima.select(*key, "kind", F.array(*[f"a{k}" for k in range(samples)]).alias("_a"))
    of = values.groupBy(*key).agg(*[F.max(F.when(F.col("kind") == i, F.col("_a"))).alias(f"_a{i}") for i in range(3)])
    return of.select(*key, *[_signature(F.col("_a0"), F.col(f"_a{i}"), samples).alias(f"signature_{c}") for i, c in ((1, one), (2, other))])


def _signature(shared: Column, own: Column, samples: int) -> Column:
    least = [F.least(F.get(shared, F.lit(k)), F.get(own, F.lit(k))) for k in range(samples)]
    parts = [F.substring(F.unhex(F.lpad(F.hex(F.xxhash64(x)), 16, "0")), 1, SAMPLE_BYTES) for x in least]
    return F.when(shared.isNotNull() | own.isNotNull(), F.concat(*parts))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples; 1 for two empty texts, 0 for an empty one and another."""
    equal = F.size(
        F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substring(a, k * SAMPLE_BYTES + 1, F.lit(SAMPLE_BYTES)) == F.substring(b, k * SAMPLE_BYTES + 1, F.lit(SAMPLE_BYTES)))
    )
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal / F.lit(float(samples)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text of docs (doc_id, text) and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by as many (or all) that begin the next
    document in ascending order of doc_id (after the last: the first). Terms are words, weighted by how often they
    occur. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text
    is empty; a text without words has the fingerprint of zeros. Rows that repeat a doc_id follow one another by a hash
    of their text; equal rows share one place and each get a row. A null doc_id comes first. Other columns are ignored.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("_d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    once = keyed.withColumn("_n", F.row_number().over(W.partitionBy("_d", "_h").orderBy("_h"))).where("_n = 1").drop("_n")
    near = cut(neighbours(keyed.select("_d", "_h", F.char_length("text").alias("n"))))
    # Whole texts are shuffled once, by (_d, _h), which both joins read; of the next text only what its predecessor takes.
    own = once
    heads = once.join(near.select(F.col("_d").alias("_od"), F.col("_h").alias("_oh"), "_pd", "_ph", "_pn"), (F.col("_d") == F.col("_od")) & (F.col("_h") == F.col("_oh")))
    heads = heads.select("_pd", "_ph", F.substring("text", F.lit(1), F.floor(F.col("_pn") / 4).cast("int")).alias("head"))
    both = own.join(heads.hint("merge"), (F.col("_d") == F.col("_pd")) & (F.col("_h") == F.col("_ph")))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "head")
    pairs = both.select("_d", "_h", "text", edited.alias("edited"))
    # The digests read the shuffled texts once more; both sides are partitioned by (_d, _h) already.
    digests = pairs.select(F.col("_d").alias("_ed"), F.col("_h").alias("_eh"), F.sha2("edited", 256).alias("edited_sha256"))
    signed = signatures(pairs, ["_d", "_h"], "text", "edited", samples)
    found = digests.join(signed, (F.col("_d") == F.col("_ed")) & (F.col("_h") == F.col("_eh")), "left").select(
        F.col("_ed").alias("_d"), F.col("_eh").alias("_h"), "edited_sha256", "signature_text", "signature_edited"
    )
    signed = cut(found)
    numbers = near.select(F.col("_d").alias("_nrd"), F.col("_h").alias("_nrh"), F.col("n").alias("n_chars"), "copies", F.col("_nd").alias("_fnd"), F.col("_nh").alias("_fnh"))
    following = signed.select(F.col("_d").alias("_fd"), F.col("_h").alias("_fh"), F.col("signature_text").alias("_next"))
    full = signed.join(numbers, (F.col("_d") == F.col("_nrd")) & (F.col("_h") == F.col("_nrh"))).join(following, (F.col("_fnd") == F.col("_fd")) & (F.col("_fnh") == F.col("_fh")))
    zeros = "00" * SAMPLE_BYTES * samples
    shown = lambda c: F.coalesce(F.lower(F.hex(c)), F.lit(zeros))
    return full.select(
        F.nullif("_d", F.lit(SMALLEST)).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        shown("signature_text").alias("fingerprint"),
        shown("signature_edited").alias("edited_fingerprint"),
        likeness(F.col("signature_text"), F.col("signature_edited"), samples).alias("near_edited"),
        likeness(F.col("signature_text"), F.col("_next"), samples).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).drop("_copy")
