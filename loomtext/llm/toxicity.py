"""Toxicity (5): a weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers case, drops zero-width characters, turns compatibility forms (full-width letters) into plain ones, strips
combining marks from Latin letters, maps homoglyphs and digits inside words to the letters they stand for, turns the rest
into single blanks and joins words that are spelled letter by letter. As a 1 may stand for i or for l, a text with one is
folded both ways and the heavier folding counts.
Matches inside an exception phrase don't count. The score is the weight of the matches by the length of the text,
calibrated by isotonic regression.
The lexicon is learned: words that are far more frequent in labelled toxic texts than in others, weighted by log odds, and
phrases of two words of which neither is in it. Exception phrases are learned too, beside those of a short list: pairs of
words, of which one is in the lexicon, that are no more frequent in toxic texts than in others. Calibration reads labelled
rows that the lexicon was not learned from.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.calibrate import binned_counts, isotonic
from loomtext.llm.common import byte_texts, cut, gram_hashes, hash_words, label_column, with_held_out

# Letters of other scripts that look like Latin ones, and what they fold to.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁѵкмтвнгαοερτυνικ",
        "aeopcyxijsdvkmtbhraoeptuvik",
        strict=True,
    )
)
# Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "white trash bag", "pond scum", "sore loser")

#: Labelled rows that the lexicon is learned from, at most; calibration takes all.
LEXICON_ROWS = 20_000
#: Words of the lexicon, at most: a size of the model.
LEXICON_WORDS = 2_000
#: Phrases, and learned exceptions, at most: sizes of the model too.
LEXICON_PHRASES = 1_000
#: One in so many labelled rows calibrates the score instead of making the lexicon.
CALIBRATES = 4
MIN_SUPPORT = 5
MIN_LOG_ODDS = 2.0
LOW, HIGH, BINS = 0.0, 12.0, 2400

_FOLD = str.maketrans(HOMOGLYPHS)
_ZERO_WIDTH = re.compile("[\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_MARKS = re.compile("(?<=[a-z])[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_STANDS = re.compile(r"(?<=[^\W_])[@$!]+(?=[^\W\d_])|[@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_])\$+(?!\w)")
_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578]+(?=[^\W_])|(?<![^\W_])[0134578]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![^\W_])")
_OTHER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<= )(?:[^\W\d_] ){3,}[^\W\d_](?= )")


def fold(text: str, one: str = "i") -> str:
    """Blank-separated folded words, with a blank before and behind. one: what a 1 inside a word stands for."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _ZERO_WIDTH.sub("", text)).lower()
        # Marks on letters of other scripts are put back.
        text = unicodedata.normalize("NFC", _MARKS.sub("", text)).translate(_FOLD)
    stand = lambda m: "".join(one if c == "1" else DIGITS[c] for c in m.group())
    if "@" in text or "$" in text or "!" in text:
        text = _STANDS.sub(stand, text)
    if any(d in text for d in "0134578"):
        text = _DIGIT.sub(stand, text)
    folded = f" {_OTHER.sub(' ', text).strip()} "
    return _SPELLED.sub(lambda m: m.group().replace(" ", ""), folded)


class Lexicon(NamedTuple):
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """Finds whole folded words of a lexicon in one pass, longest phrases included."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, weight in lexicon.weights.items():
            self.automaton.add_word(f" {word} ", (len(word) + 2, weight))
        for phrase in lexicon.exceptions:
            folded = fold(phrase)
            self.automaton.add_word(folded, (len(folded), None))
        self.usable = len(self.automaton) > 0
        self.automaton.make_automaton()

    def weight(self, folded: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of the weights and the matches (start, end in the folded text, weight) outside exceptions."""
        if not self.usable:
            return 0.0, []
        found, excepted = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (excepted if weight is None else found).append((end - size + 1, end, weight))
        if excepted:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b, _ in excepted)]
        return sum(m[2] for m in found), found


def density(matcher: Matcher, text: bytes) -> float:
    """Weight by length on a scale of its logarithm: 0 without a match, else 1 and more from one in a million words on."""
    plain = text.decode("utf-8", "replace")
    folded = fold(plain)
    total = matcher.weight(folded)[0]
    if "1" in plain and (other := fold(plain, "l")) != folded:
        total = max(total, matcher.weight(other)[0])
    return 0.0 if total <= 0 else max(1.0, 1.0 + float(np.log1p(1e6 * total / max(folded.count(" ") - 1, 1))) / 2)


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """docs: doc_id, text; labels: doc_id, label. At most LEXICON_ROWS labelled rows are read, chosen by a hash of doc_id.

    Near copies are counted once (texts are grouped by the least hash of their runs of five words), or a large group of
    copies of one toxic text would put all its words into the lexicon.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICON_ROWS)
    sample = docs.join(F.broadcast(cut(chosen)), "doc_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms, kinds = [], []
            for text in byte_texts(batch):
                folded = fold(text.decode("utf-8", "replace")).split()
                hashed = hash_words((w.encode() for w in folded), len(folded))
                kinds.append(int(gram_hashes(hashed, 5).min().astype(np.int64)) if len(folded) >= 5 else int(hashed.min().astype(np.int64)) if len(folded) else 0)
                terms.append(sorted({w for w in folded if len(w) > 2} | {f"{v} {w}" for v, w in pairwise(folded)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(kinds, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                names=["doc_id", "label", "kind", "terms"],
            )

    texts = cut(sample.select("doc_id", "label", F.col("text").cast("string")).mapInArrow(run, "doc_id long, label double, kind long, terms array<string>"))
    first = texts.groupBy("kind").agg(F.min("doc_id").alias("_first")).select(F.col("kind").alias("_kind"), "_first")
    once = texts.join(first, (F.col("kind") == F.col("_kind")) & (F.col("doc_id") == F.col("_first")))
    n = once.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    toxic, other = n["toxic"], n["all"] - n["toxic"]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
    counts = cut(
        once.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
        .where(F.greatest("t", "o") >= MIN_SUPPORT)
        .withColumn("weight", odds)
    )
    phrase = F.col("term").contains(" ")
    toxic_terms = counts.where((F.col("t") >= MIN_SUPPORT) & (F.col("weight") >= MIN_LOG_ODDS)).orderBy(F.desc(F.col("weight") * F.sqrt("t")), "term")
    weights = {r["term"]: float(r["weight"]) for r in toxic_terms.where(~phrase).limit(LEXICON_WORDS).collect()}
    # Phrases are chosen among those without a word of the lexicon, exceptions among those with one; both lists are bounded.
    in_lexicon = F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, weights))) if weights else F.lit(False)
    phrases = toxic_terms.where(phrase & ~in_lexicon).limit(LEXICON_PHRASES).collect()
    harmless = counts.where(phrase & in_lexicon & (F.col("o") >= MIN_SUPPORT) & (F.col("weight") <= 0)).orderBy(F.desc("o"), "term").limit(LEXICON_PHRASES).collect()
    return Lexicon(weights | {r["term"]: float(r["weight"]) for r in phrases}, (*EXCEPTIONS, *(r["term"] for r in harmless)))


def with_density(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and density of every whole text."""

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(lexicon)
        for batch in batches:
            found = [density(matcher, text) for text in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "density"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, density double")


def _calibrates() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CALIBRATES)) == 0


def _usable(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """doc_id, label of the labelled rows that are not held out."""
    return with_held_out(label_column(docs.sparkSession, labels, name), 5, 0).where("not held_out").drop("held_out")


def _calibration(dense: DataFrame, usable: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibrated score. dense: doc_id, density of the rows that calibrate, or of more."""
    counts = binned_counts(dense.where(_calibrates()).join(usable, "doc_id"), F.col("density"), F.col("label"), LOW, HIGH, BINS)
    return isotonic(counts, LOW, HIGH, BINS)


def keep_clean(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> DataFrame:
    """The rows of docs, with all their columns, whose text is scored below 0.5; see score_toxicity().

    Calibration matches only the texts that calibrate, so each text but those is matched once. Null and empty texts match
    nothing. Everything stays where no lexicon can be learned, and where the calibrated score is on one side of 0.5 for all
    densities, as it tells no toxic text from others then (score_toxicity() predicts 1 for all if that is the upper side).
    Repeated rows are judged each by itself.
    """
    usable = _usable(docs, labels, name)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = learn_lexicon(texts, usable.where(~_calibrates()))
    if not lexicon.weights:
        return docs
    x, y = _calibration(with_density(with_held_out(texts, 5, 0).where(~F.col("held_out") & _calibrates()), lexicon), usable)
    if y.max() < 0.5 or y.min() >= 0.5:
        return docs

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(lexicon)
        for batch in batches:
            keep = [float(np.interp(density(matcher, text), x, y)) < 0.5 for text in byte_texts(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> DataFrame:
    """Scores every whole text of docs (doc_id, text), learning from labels (doc_id, name) of documents not held out.

    Returns doc_id, held_out (crc32 of doc_id as text leaves 0 by 5), score (0 to 1), predicted (1 from 0.5). An empty
    or null text matches nothing. Rows that repeat a doc_id are scored each by itself; contradicting labels take their
    mean, half counting as 1; a null doc_id has no label and is not held out. Without usable labels, or none among those
    that calibrate, every score is 0.5. Other columns are ignored.
    """
    usable = _usable(docs, labels, name)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = learn_lexicon(texts, usable.where(~_calibrates()))
    dense = cut(with_held_out(with_density(texts, lexicon), 5, 0))
    x, y = _calibration(dense, usable)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.clip(np.interp(batch.column("density").to_numpy(zero_copy_only=False), x, y), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return dense.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
