"""Places of terms in texts by one scan: an automaton finds all, a sweep over intervals keeps the longest."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

_WORD = re.compile(r"\w")


def _lowered(text: str) -> str:
    """Lower case, sign by sign, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def term_automaton(terms: Sequence[str], masks: Sequence[str] = ()):
    """Terms in order of preference (the longest first, then as given), behind them the beginnings of words that hide terms."""
    import ahocorasick

    found = ahocorasick.Automaton()
    order = sorted(dict.fromkeys(t for t in terms if t), key=lambda t: -len(t))
    for rank, term in enumerate(order):
        found.add_word(_lowered(term), (rank, len(term), term))
    for mask in masks:
        found.add_word(_lowered(mask), (-1, len(mask), ""))
    found.make_automaton()
    return found


def longest_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """(term, start, stop) of the words that begin with a term, in order of their starts.

    Of spans that overlap, that of the longer term stays, of equal terms the first; a word that begins with a mask has none.
    """
    low, found = _lowered(text), []
    for last, (rank, length, term) in automaton.iter(low):
        start, stop = last + 1 - length, last + 1
        if start and _WORD.match(low[start - 1]) and _WORD.match(low[start]):
            continue
        while stop < len(low) and _WORD.match(low[stop]):
            stop += 1
        found.append((rank, start, stop, term))
    kept: list[tuple[int, int, str]] = []
    for rank, start, stop, term in sorted(found):
        at = bisect_left(kept, (start,))
        if at < len(kept) and kept[at][0] < stop or at and kept[at - 1][1] > start:
            continue
        kept.insert(at, (start, stop, term if rank >= 0 else ""))
    return [(term, start, stop) for start, stop, term in kept if term]


def term_spans(texts: DataFrame, terms: Sequence[str], masks: Sequence[str] = ()) -> DataFrame:
    """id, text -> id, term, start (from 0), word: each place where a word begins with a term. Case does not matter.

    The terms are a dictionary that every task holds. Null texts have no places; a term may be several words; terms that
    differ in case alone are the last of them.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        automaton = term_automaton(terms, masks) if terms or masks else None
        for b in batches:
            rows = [(i, term, start, t[start:stop]) for i, t in zip(b["id"], b["text"], strict=True) if t and automaton for term, start, stop in longest_spans(t, automaton)]
            yield pd.DataFrame(rows, columns=["id", "term", "start", "word"])

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, term string, start int, word string")
