"""Substring dedup (4): prefix-partitioned sparse suffix trees, in groups that fit in memory.

Suffixes are sampled: of the suffixes that start in a window of `window` words and share at least `prefix` words with it, the
one with the least-hashed leading `prefix` words (the leftmost of equals) serves the window, so equal windows are served by
suffixes that lead with the same words. With 8 of 20 words, one suffix serves about six windows in a row; their words, from the
first window's start to the last one's end, are its segment.

Sampled suffixes are partitioned by their own leading words: a group is a subtree of the tree of all sampled suffixes. Equal
segments of a group are one, that of the earliest, before any text is moved; windows of the later ones are all repeated. A
group with one segment needs no tree. A group with more segments than memory should hold is split by longer prefixes, of 14,
17, 19 and at last 20 words, with suffixes sampled anew for each length as a short one need not reach that far into its
windows. At 20 words every window has its own suffix and a group is a single node.

A tree is its sorted suffixes with the lengths of the prefixes that neighbours share. Under an internal node of depth d, suffixes
with the same l words before them share l + d words: where this is `window` or more, a repeat. Each window is judged at the
topmost node that is deep enough for its words from the suffix on, and the earliest of those with equal words before it stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import Scratch, byte_texts, cut, gram_hashes, hash_words, mix

WINDOW = 20
PREFIX = 8
#: Different segments of a group that one tree holds (each about window + 6 words); larger groups get longer runs.
GROUP_SEGMENTS = 2_000
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones((2, 1), np.uint64)  # of _BASE and of its inverse, as many as were needed


def prefix_lengths(window: int, prefix: int) -> list[int]:
    """The lengths of runs that a group goes through, each halfway from the one before to the window."""
    lengths = [min(prefix, window)]
    while lengths[-1] < window:
        lengths.append((lengths[-1] + window + 1) // 2)
    return lengths


def anchors(hashed: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sampled suffixes of a document: hash of their leading words, starts, first and last start of the windows they serve."""
    n = len(hashed) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = gram_hashes(hashed, prefix)
    span = window - prefix + 1
    at = np.concatenate(
        [np.lib.stride_tricks.sliding_window_view(grams[i : i + 65536 + span - 1], span).argmin(axis=1) + i for i in range(0, n, 65536)]
    ) + np.concatenate([np.arange(min(65536, n - i)) for i in range(0, n, 65536)])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return grams[at[first]].astype(np.int64), at[first], first, last


def span_hashes(hashed: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the words first to end (exclusive) of each span, by differences of one running sum."""
    global _POWERS
    n = len(hashed)
    with np.errstate(over="ignore"):
        if _POWERS.shape[1] <= n:
            steps = np.full((2, 2 * n + 2), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
            _POWERS = np.cumprod(steps, axis=1, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _POWERS[0, :n])])
        return mix((total[end] - total[first]) * _POWERS[1, first], (end - first).astype(np.uint64)).astype(np.int64)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """_d and _h tell documents apart and order them: doc_id, null first, and a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("text"), *columns)


_ROW = "key long, seg long, _d long, _h long, lo int, n int, at int"


def _sampled(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """key, seg (hash of the segment's words), _d, _h, lo (start of the first window served), n (windows served), at (suffix, from lo)."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            parts: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, h, text in zip(batch.column("_d").to_pylist(), batch.column("_h").to_pylist(), byte_texts(batch), strict=True):
                words = text.split()
                if len(words) >= window:
                    hashed = hash_words(words, len(words))
                    key, at, lo, hi = anchors(hashed, window, prefix)
                    for part, values in zip(parts, (key, span_hashes(hashed, lo, hi + window), np.full(len(key), doc), np.full(len(key), h), lo, hi - lo + 1, at - lo), strict=True):
                        part.append(values)
            arrays = [pa.array(np.concatenate(p) if p else np.empty(0, np.int64), pa.int64()).cast(t) for p, t in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "seg", "_d", "_h", "lo", "n", "at"])

    return docs.select("_d", "_h", "text").mapInArrow(run, _ROW)


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """The words of the segments that each document (_d, _h, text, wanted: key, seg, lo, n, at) is asked for."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for doc, h, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("_d", "_h")), byte_texts(batch), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                rows += [(w["key"], w["seg"], doc, h, w["lo"], w["n"], w["at"], b" ".join(words[w["lo"] : w["lo"] + w["n"] + window - 1])) for w in wanted]
            yield _segment_batch(rows)

    return docs.mapInArrow(run, f"{_ROW}, words binary")


def _segment_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "seg", "_d", "_h", "lo", "n", "at", "words"])


def _split(segments: DataFrame, window: int, prefix: int) -> DataFrame:
    """The segments' windows served by suffixes with longer prefixes. Equal windows come from one group and go to one group."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, h, lo, text in zip(*(batch.column(c).to_pylist() for c in ("_d", "_h", "lo", "words")), strict=True):
                words = text.split()
                hashed = hash_words(words, len(words))
                keys, at, first, last = anchors(hashed, window, prefix)
                for k, s, x, a, b in zip(*(v.tolist() for v in (keys, span_hashes(hashed, first, last + window), at, first, last)), strict=True):
                    rows.append((k, s, doc, h, lo + a, b - a + 1, x - a, b" ".join(words[a : b + window])))
            yield _segment_batch(rows)

    return segments.mapInArrow(run, f"{_ROW}, words binary")


class SuffixTree:
    """The tree of a group of sampled suffixes: sorted, with shared prefix lengths.

    segments: (place, words, at, n): words from the first of n windows on, of the suffix at the word `at`; the last part of a
    place is that of the first word. suffixes: segments in the order of their suffixes; shared[k]: words that suffix k shares with the one before.
    """

    def __init__(self, segments: list[tuple[tuple, list[bytes], int, int]], window: int) -> None:
        self.segments, self.window = segments, window
        rows = sorted((words[at:], s) for s, (_, words, at, _) in enumerate(segments))
        self.suffixes = [s for _, s in rows]
        self.shared = [0] * len(rows)
        for k in range(1, len(rows)):
            a, b = rows[k - 1][0], rows[k][0]
            n = 0
            while n < len(a) and n < len(b) and a[n] == b[n]:
                n += 1
            self.shared[k] = n

    def nodes(self) -> Iterator[tuple[int, int, int, int]]:
        """(depth of the parent, depth, first, last) of each internal node below the root, children before parents."""
        open_: list[tuple[int, int]] = []
        for k in range(1, len(self.suffixes) + 1):
            depth, first = self.shared[k] if k < len(self.suffixes) else 0, k - 1
            while open_ and open_[-1][0] > depth:
                below, first = open_.pop()
                yield max(depth, open_[-1][0] if open_ else 0), below, first, k - 1
            if depth and (not open_ or open_[-1][0] < depth):
                open_.append((depth, first))

    def repeats(self) -> Iterator[tuple[int, list[int]]]:
        """(words before the suffix, segments) of each set of equal windows, from the topmost node that is deep enough for them."""
        for above, depth, first, last in self.nodes():
            leaves = self.suffixes[first : last + 1]
            for right in range(above + 1, min(depth, self.window) + 1):
                left, same = self.window - right, {}
                for s in leaves:
                    _, words, at, n = self.segments[s]
                    if 0 <= at - left < n:
                        same.setdefault(tuple(words[at - left : at]), []).append(s)
                yield from ((left, found) for found in same.values() if len(found) > 1)

    def repeated(self) -> Iterator[tuple[int, int, int]]:
        """(segment, first window, windows) of the runs of windows that an earlier one equals."""
        late: dict[int, set[int]] = {}
        for left, found in self.repeats():
            places = {s: (*self.segments[s][0][:-1], self.segments[s][0][-1] + self.segments[s][2] - left) for s in found}
            earliest = min(places.values())
            for s in found:
                if places[s] != earliest:  # a row that is there twice has one place
                    late.setdefault(s, set()).add(self.segments[s][2] - left)
        for s, starts in late.items():
            for first in sorted(i for i in starts if i - 1 not in starts):
                n = 1
                while first + n in starts:
                    n += 1
                yield s, first, n


def _tree_repeats(segments: DataFrame, window: int) -> DataFrame:
    """_d, _h, lo, n: the repeated windows in the trees of all groups; rows of a group are next to one another."""

    def run(batches):
        import pyarrow as pa

        def close() -> list[tuple]:
            if len(group) < 2:
                return []
            return [(*group[s][0][:2], group[s][0][2] + first, n) for s, first, n in SuffixTree(group, window).repeated()]

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_d", "_h", "lo", "n"])

        key, group = None, []
        for batch in batches:
            found: list[tuple] = []
            for k, doc, h, lo, n, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "_d", "_h", "lo", "n", "at", "words")), strict=True):
                if k != key:
                    found += close()
                    key, group = k, []
                group.append(((doc, h, lo), text.split(), at, n))
            yield out(found)
        yield out(close())

    return segments.select("key", "_d", "_h", "lo", "n", "at", "words").repartition("key").sortWithinPartitions("key").mapInArrow(run, "_d long, _h long, lo int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """_d, _h, spans (lo, n: n windows from the word lo on) of the windows whose words also start earlier. docs: _d, _h, text."""
    place, after = F.struct("_d", "_h", "lo"), lambda first: F.struct("_d", "_h", "lo") > F.struct(*[F.col(f"{first}.{c}") for c in ("_d", "_h", "lo")])
    lengths = prefix_lengths(window, prefix)
    scratch = Scratch(docs.sparkSession)
    try:
        rows = scratch.write(_sampled(docs, window, lengths[0]), "sampled")
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("seg").alias("_lo"), F.max("seg").alias("_hi")).where("_n > 1")
        groups = groups.select(F.col("key").alias("_key"), (F.col("_lo") < F.col("_hi")).alias("several"))
        alive = scratch.write(rows.join(groups, F.col("key") == F.col("_key")).drop("_key"), "alive")
        scratch.drop("sampled")
        # Each segment is kept once; of groups with several, which need a tree, its words are fetched.
        first = F.min(F.struct("_d", "_h", "lo", "n", "at")).alias("_first")
        once = scratch.write(alive.groupBy("key", "seg").agg(first, F.count(F.lit(1)).alias("_n"), F.bool_or("several").alias("several")), "once")
        again = once.where("_n > 1").select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), "_first")
        late = [alive.join(again, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg"))).where(after("_first")).select("_d", "_h", "lo", "n")]
        once = once.where("several")
        wanted = once.select("key", "seg", "_first.*").groupBy(F.col("_d").alias("_wd"), F.col("_h").alias("_wh")).agg(F.collect_list(F.struct("key", "seg", "lo", "n", "at")).alias("wanted"))
        asked = docs.join(wanted, (F.col("_d") == F.col("_wd")) & (F.col("_h") == F.col("_wh"))).select("_d", "_h", "text", "wanted")
        segments = scratch.write(_segments(asked, window), "segments")
        for k, longer in enumerate([*lengths[1:], None]):
            sizes = segments.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
            large = None if longer is None else cut(sizes.where(F.col("_n") > group_segments).select(F.col("key").alias("_key")))
            if large is None or large.isEmpty():
                late.append(_tree_repeats(segments, window))
                break
            late.append(_tree_repeats(segments.join(large, F.col("key") == F.col("_key"), "left_anti"), window))
            longer_rows = scratch.write(_split(segments.join(large, F.col("key") == F.col("_key"), "left_semi"), window, longer), f"split{k}")
            firsts = longer_rows.groupBy("key", "seg").agg(F.min(place).alias("_first"), F.min_by(F.struct("n", "at"), place).alias("_size"), F.min_by("words", place).alias("words"))
            segments = scratch.write(firsts.select("key", "seg", "_first.*", "_size.*", "words"), f"segments{k}")
            kept = segments.select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), F.struct("_d", "_h", "lo").alias("_first"))
            late.append(longer_rows.join(kept, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg"))).where(after("_first")).select("_d", "_h", "lo", "n"))
        found = late[0]
        for part in late[1:]:
            found = found.union(part)
        return cut(found.groupBy("_d", "_h").agg(F.collect_list(F.struct("lo", "n")).alias("spans")))
    finally:
        scratch.drop()


def _covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words the windows of spans cover."""
    change = np.zeros(n + 1, np.int32)
    lo, many = np.array([s["lo"] for s in spans], np.int64), np.array([s["n"] for s in spans], np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, lo + many - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_words(text: bytes, covered: np.ndarray) -> bytes:
    """The text without its covered words; blanks between the words that stay are left as they are.

    Of the blanks around a removed run, those before it stay.
    """
    out, end, skipping = [], 0, False
    for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
        if covered[i]:
            if not skipping:
                out.append(text[end : m.start()])
            skipping = True
        else:
            out.append(m.group() if skipping else text[end : m.end()])
            skipping = False
        end = m.end()
    return b"".join([*out, text[end:]])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_segments: int = GROUP_SEGMENTS, columns: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word that a repeated window of `window` words covers; the earliest copy of a window stays.

    docs: doc_id, text and, if named, columns to pass through. Windows are judged on the input: one is repeated if its
    word sequence also starts at a smaller doc_id, or earlier in the same document. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words, joined by one space), kept_text (the text without the removed words) and columns.
    A null text has no words and stays null; a null doc_id is smaller than others. Rows that repeat a doc_id with
    different texts are documents of their own, in the order of a hash of their texts (xxhash64); equal rows are one
    document, so each gets what that has. An empty table gives no rows. Other columns are ignored.
    """
    keyed = _keyed(docs)
    found = repeated_windows(keyed, window, prefix, group_segments).select(F.col("_d").alias("_fd"), F.col("_h").alias("_fh"), "spans")
    passed = [c for c in columns if c not in ("doc_id", "text")]
    full = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_passed_{c}") for c in passed])
    full = full.join(found, (F.col("_d") == F.col("_fd")) & (F.col("_h") == F.col("_fh")), "left").drop("_d", "_h", "_fd", "_fh")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            nulls = batch.column("text").is_null().to_pylist()
            for text, spans, null in zip(byte_texts(batch), batch.column("spans").to_pylist(), nulls, strict=True):
                words = text.split()
                kept, left = words, text
                if spans:
                    covered = _covered(len(words), spans, window)
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    left = remove_words(text, covered)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                texts.append(None if null else left)
            arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(f"_passed_{c}") for c in passed)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *passed])

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in passed)
    return full.mapInArrow(run, schema)
