"""Token counts (7): offset-mapped attribution.

A whole document is encoded once. The tokens' lengths in bytes give each its span of the text; sections are spans too, and
an interval join attributes tokens to sections. A token that crosses a boundary is allocated by a stated rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import byte_texts

TOKENIZER = "byte_bpe_50k.tiktoken"
#: How a token that crosses boundaries is allocated: to the section of its first or last byte, to the section that has most
#: of its bytes (the first of equals), or to each in proportion to its bytes.
RULES = ("first", "last", "most", "share")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ByteEncoder:
    """Ids and lengths in bytes of a text's tokens."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each token."""
        ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), np.int64)
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids], ends


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each line; a line ends behind its line end, so that the lines tile the text."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts = np.concatenate([[0], breaks])
    ends = np.concatenate([breaks, [len(text)]])
    keep = starts < ends
    return starts[keep], ends[keep]


def attribute(starts: np.ndarray, ends: np.ndarray, s0: np.ndarray, s1: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, of them crossing), for token spans and section spans that both tile the text in order."""
    n = len(s0)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(starts):
        return counts, crossing
    first = np.searchsorted(s1, starts, "right")
    last = np.searchsorted(s1, ends - 1, "right")
    inside = first == last
    counts += np.bincount(first[inside], minlength=n)
    for k in np.flatnonzero(~inside).tolist():
        over = np.arange(first[k], last[k] + 1)
        shared = np.minimum(ends[k], s1[over]) - np.maximum(starts[k], s0[over])
        crossing[over] += 1
        if rule == "share":
            counts[over] += shared / shared.sum()
        else:
            counts[{"first": over[0], "last": over[-1], "most": over[int(np.argmax(shared))]}[rule]] += 1
    return counts, crossing


def _ends(ends: list[int] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that tile `size` bytes from where they end, in order; what lies behind the last end is the last span's."""
    stops = np.minimum(np.maximum.accumulate(np.array([e or 0 for e in ends or []] or [size], np.int64)), size)
    stops[-1] = size
    return np.concatenate([[0], stops[:-1]]), stops


def section_tokens(docs: DataFrame, rule: str = "first", path: str | None = None, ends: Column | None = None) -> DataFrame:
    """Tokens of each section of each whole document (doc_id, text), which is encoded once as a whole.

    ends: the bytes (array<long>, ascending) at which a document's sections end, the last with the text; without it the
    sections are the lines. Returns doc_id, section (from 0), n_bytes, n_tokens (a fraction by the rule "share"), n_crossing
    (tokens of which only a part is in the section), doc_tokens (of the whole document). The tokens of a document's sections
    sum to doc_tokens. An empty or null text has one row for lines: section 0 without tokens, and one for each of its ends
    otherwise; sections without bytes have no tokens; null ends are one section. Rows that repeat a doc_id are counted each
    by itself; a null doc_id stays null; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    file, lines = path or tokenizer_path(), ends is None
    schema = "doc_id long, section int, n_bytes long, n_tokens double, n_crossing long, doc_tokens long"

    def run(batches):
        import pyarrow as pa

        encoder = ByteEncoder(file)
        for batch in batches:
            docs_, parts = [], ([], [], [], [], [])
            for doc, text, stops in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), batch.column("_ends").to_pylist(), strict=True):
                starts, ends = encoder.spans(text)
                s0, s1 = _ends(stops, len(text)) if not lines else line_spans(text) if text else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                some = s0 < s1
                counts, crossing = np.zeros(len(s0)), np.zeros(len(s0), np.int64)
                counts[some], crossing[some] = attribute(starts, ends, s0[some], s1[some], rule)
                docs_ += [doc] * len(s0)
                for part, values in zip(parts, (np.arange(len(s0), dtype=np.int32), s1 - s0, counts, crossing, np.full(len(s0), len(starts), np.int64)), strict=True):
                    part.append(values)
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            arrays = [pa.array(np.concatenate(p) if p else [], t) for p, t in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), *arrays], names=["doc_id", "section", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])

    stops = F.lit(None).cast("array<long>") if lines else ends.cast("array<long>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stops.alias("_ends")).mapInArrow(run, schema)


def field_tokens(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", path: str | None = None) -> DataFrame:
    """Tokens of each field of docs (doc_id and the fields), encoded as one text with a separator behind each field but the last.

    Returns what section_tokens() does; section is the field's place in `fields`, and a separator belongs to the field
    before it. A null field is empty.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    parts = [F.concat(p, F.lit(separator)) for p in parts[:-1]] + parts[-1:]
    ends, total = [], F.lit(0)
    for part in parts:
        total = total + F.octet_length(part)
        ends.append(total.cast("long"))
    whole = docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*ends).alias("_stops"))
    return section_tokens(whole, rule, path, F.col("_stops"))
