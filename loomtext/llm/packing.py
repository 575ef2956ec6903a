"""Best-fit packing (10): minimum bin slack over the histogram of piece lengths.

The method packs a bin at a time: a bitset subset-sum over the lengths that are left finds the fullest feasible
combination, which is then removed. Lengths are at most `capacity`, so what is left is a histogram of at most
`capacity` counts, whatever the input's size. The same combination stays the fullest while its lengths last, so it is
removed as often as they allow at once: a plan has a few thousand combinations at most. Pieces are then dealt to the
plan by their rank within their length, which each task works out for itself. A bin is seeded with the longest length that
is left. Pieces as long as a bin are a bin each: they are numbered where they lie and take no part in ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bucketed_rank, byte_texts, cut

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Words whose ids a worker remembers at most (about 100 MB); others are encoded each time.
CACHE_WORDS = 400_000
#: Rows of one length that a task ranks, about, and hash buckets that a length has at least.
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 64
#: Signs that are never part of a contraction.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Combination(NamedTuple):
    lengths: tuple[int, ...]  # descending
    counts: tuple[int, ...]
    bins: int


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Ids of a text from ids of its words.

    The tokenizer splits at white space before it merges, so a text's ids are its words' ids in order. Words not seen
    before are encoded together, as one text, where their pre-tokens are plain, else each alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _encode_joined(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """One text of parts that are one pre-token each, cut where the vocabulary says that one ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(parts):
            return self._encode(parts)
        stops = (4 * ends).tolist()
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(parts, [0, *stops], stops)}  # noqa: B905

    @property
    def word_end(self) -> np.ndarray:
        if "_word_end" not in self.__dict__:
            vocab = self.tokenizer.get_vocab()
            self._word_end = np.zeros(max(vocab.values()) + 1, bool)
            for piece, i in vocab.items():
                self._word_end[i] = piece.endswith("</w>")
        return self._word_end

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that has the words' ids. Letters are one pre-token and a tail of ASCII signs behind them is another."""
        new, cache = {}, self.cache
        plain: set[bytes] = set()
        rest, built = [], []
        for w in words:
            if w not in cache:
                letters = w.rstrip(SIGNS)
                if letters.decode("utf-8", "replace").isalpha():
                    plain.add(letters)
                    if letters != w:
                        plain.add(w[len(letters) :])
                        built.append((w, letters, w[len(letters) :]))
                else:
                    rest.append(w)
        parts = [w for w in plain if w not in cache]
        for i in range(0, len(parts), 2000):
            new |= self._encode_joined(parts[i : i + 2000])
        for i in range(0, len(rest), 2000):
            new |= self._encode(rest[i : i + 2000])
        for w, letters, tail in built:
            new[w] = (new.get(letters) or cache[letters]) + (new.get(tail) or cache[tail])
        if len(cache) + len(new) <= CACHE_WORDS:
            cache |= new
            return cache
        return _Both(cache, new)

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for i in range(0, len(texts), 500):
            # The tokenizer lowers case itself; lowered before, fewer words are new. Special tokens are told by their case.
            part = [(t if b"<|" in t else t.lower()).split() for t in texts[i : i + 500]]
            table = self.learn(set().union(*part) if part else set())
            get = table.__getitem__
            for words in part:
                yield b"".join(map(get, words))


class _Both(dict):
    """A small table backed by a large one."""

    def __init__(self, large: dict, small: dict) -> None:
        super().__init__(small)
        self.large = large

    def __missing__(self, key):
        return self.large[key]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document; see pack()."""

    def run(batches):
        import pyarrow as pa

        encoder = WordEncoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, raw in zip(ids, encoder.ids(byte_texts(batch)), strict=True):
                raw += end
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(left: dict[int, int], capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The largest length that is left, with those of the others that fill the bin best: (lengths, counts)."""
    lengths = sorted(left, reverse=True)
    seed, room = lengths[0], capacity - lengths[0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        have = min(left[n] - (n == seed), room // n)
        take = 1
        while have > 0:  # multiples by powers of two
            take = min(take, have)
            grown = reach | (reach << (take * n)) & mask
            if grown != reach:
                steps.append((n, take, reach))
                reach = grown
            have -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    counts = {seed: 1}
    for n, take, before in reversed(steps):
        if not before >> total & 1:  # the sum needs this step
            total -= n * take
            counts[n] = counts.get(n, 0) + take
    order = tuple(sorted(counts, reverse=True))
    return order, tuple(counts[n] for n in order)


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Combinations, with the number of bins that each fills, until nothing is left."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while left:
        lengths, counts = fullest(left, capacity)
        bins = min(left[n] // c for n, c in zip(lengths, counts, strict=True))
        plan.append(Combination(lengths, counts, bins))
        for n, c in zip(lengths, counts, strict=True):
            left[n] -= c * bins
            if not left[n]:
                del left[n]
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents (doc_id, text) into sequences of at most `capacity` tokens.

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Only a document longer than
    `capacity` is cut, into pieces of that length and a rest. Repeated rows are packed each by itself; a null doc_id
    stays null; other columns are ignored; an empty table gives no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. The histogram that reaches the driver has at
    most `capacity` rows.
    """
    pieces = cut(token_pieces(docs, path or tokenizer_path(), capacity))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(capacity, None)
    plan = minimum_slack_plan(histogram, capacity)
    # For each length: the ranks at which a combination begins to take it, its first bin, how many a bin takes, and where.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first_bin = dict.fromkeys(histogram, 0), 0
    for lengths, counts, bins in plan:
        at = 0
        for n, c in zip(lengths, counts, strict=True):
            slots.setdefault(n, []).append((used[n], first_bin, c, at))
            used[n] += c * bins
            at += c * n
        first_bin += bins
    tables = {n: np.array(v, np.int64).T for n, v in slots.items()}

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for where in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[where[0]])
                starts, bins, per_bin, at = tables[n]
                k = np.searchsorted(starts, rank[where], "right") - 1
                inside = rank[where] - starts[k]
                sequence[where] = bins[k] + inside // per_bin[k]
                offset[where] = at[k] + inside % per_bin[k] * n
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # The pieces were written, so a row's number is the same whenever it is read; below 0 no bin of the plan has one.
    full = pieces.where(F.col("length") == capacity).select(*kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = max(LEAST_BUCKETS, max(histogram.values(), default=0) // BUCKET_ROWS)
    ranked = bucketed_rank(pieces.where(F.col("length") < capacity), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank", buckets)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").union(full)
