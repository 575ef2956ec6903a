"""Near-duplicates and repeated passages against brute force."""

import hashlib
import re
from itertools import combinations

import pytest

from loomtext.llm import neardup, substrings
from loomtext.llm.components import components

from .conftest import edge_rows, prose


def shingles(text, width):
    words = [w.lower() if w.isascii() else re.sub(rb"[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return frozenset(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 2)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_near_duplicates_of_the_small_tables(small):
    df, rows = small
    found = neardup.near_duplicates(df, width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, 4)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t, 4)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_group_of_near_copies_and_a_common_passage(spark):
    passage = prose(99, 60)
    rows = [(i, passage + " " + prose(100 + i, 60)) for i in range(150)]  # a bucket's worth of strays
    base = prose(7, 200).split()
    for k in range(60):
        copy = list(base)
        copy[3 * k] = f"new{k}"
        rows.append((1000 + k, " ".join(copy)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, 4)


def test_edge_cases_of_near_duplicates(edge, nothing):
    found = neardup.near_duplicates(edge, width=4).collect()
    assert len(found) == len(edge_rows())
    want = brute_components([(r[0], r[1]) for r in edge_rows()], 4)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one(edge, 4).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert set(edge.columns) == set(kept[0].asDict())


def brute_removed(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        covered = [False] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                covered[p : p + window] = [True] * window
            seen.add(w)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[i] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("group", [2, 2000])
def test_repeated_passages_of_the_small_tables(small, group):
    df, rows = small
    found = substrings.dedup_substrings(df, group_segments=group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute_removed(rows, 20)


def test_removed_text_keeps_its_blanks(spark):
    repeated = prose(1, 25)
    df = spark.createDataFrame([(1, f"a\n{repeated}\nb"), (2, f"c  d\n{repeated}\n\te")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in substrings.dedup_substrings(df).collect()} == {1: f"a\n{repeated}\nb", 2: "c  d\ne"}


def removed_by_row(spark, rows, window):
    """brute_removed() by (doc_id, text), where rows that repeat a doc_id stand in the order of a hash of their texts."""
    hashed = spark.createDataFrame(list(set(rows)), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    found = brute_removed([(k, r["text"]) for k, r in enumerate(order)], window)
    return {(r["doc_id"], r["text"]): found[k] for k, r in enumerate(order)}


def test_edge_cases_of_repeated_passages(spark, edge, nothing):
    found = substrings.dedup_substrings(edge, columns=("lang", "source")).collect()
    want = removed_by_row(spark, [(r[0], r[1]) for r in edge_rows()], 20)
    key = {(r[0], len((r[1] or "").encode().split()), r[1] is None): [] for r in edge_rows()}
    for r in edge_rows():
        key[r[0], len((r[1] or "").encode().split()), r[1] is None].append(want[r[0], r[1]])
    for r in found:
        key[r["doc_id"], r["n_words"], r["kept_text"] is None].remove((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert not any(key.values())
    assert [r["kept_text"] for r in found if r["doc_id"] == 3] == [None]
    assert substrings.dedup_substrings(nothing).count() == 0


def test_rows_that_repeat_a_doc_id_keep_their_own_text(spark):
    a, b = prose(1, 40), prose(2, 40)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, b[: len(b) // 2]), (None, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(df).collect())
    half = len(b[: len(b) // 2].split())
    again = sum(len(set(w)) > 0 for w in b[: len(b) // 2].split()[:-1])  # the last word is cut off
    if b[len(b) // 2] == " ":
        again = half
    assert found == sorted([(1, 40, 0), (5, 40, 40), (5, 40, again if again >= 20 else 0), (5, 40, again if again >= 20 else 0), (0, half, 0), (0, 0, 0)])


def test_nodes_are_the_maximal_repeats_of_suffixes_with_one_prefix():
    words = lambda t: [w.encode() for w in t.split()]
    texts = ["x a b c d e y", "z a b c d e w", "z a b c d f w"]  # the suffixes at "a b" lead with the same two words
    tree = substrings.SuffixTree([((10 * k,), words(t), 1, 2) for k, t in enumerate(texts)], 4)
    assert {(above, depth, tuple(sorted(tree.suffixes[a : b + 1]))) for above, depth, a, b in tree.nodes()} == {(0, 4, (0, 1, 2)), (4, 5, (0, 1))}
    assert sorted((left, tuple(sorted(found))) for left, found in tree.repeats()) == [(0, (0, 1, 2)), (1, (1, 2))]
    assert sorted(tree.repeated()) == [(1, 1, 1), (2, 0, 2)]


def test_a_window_is_served_by_a_suffix_in_it_that_leads_with_the_words_of_its_group():
    words = [w.encode() for w in prose(5, 300).split()]
    hashed = substrings.hash_words(words, len(words))
    for prefix in substrings.prefix_lengths(20, 8):
        keys, at, first, last = substrings.anchors(hashed, 20, prefix)
        assert [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)] == list(range(len(words) - 19))
        assert all(last <= at) and all(at + prefix <= first + 20)
        by_key = {}
        for key, x in zip(keys.tolist(), at.tolist(), strict=True):
            by_key.setdefault(key, set()).add(tuple(words[x : x + prefix]))
        assert all(len(found) == 1 for found in by_key.values())


def test_prefixes_grow_to_the_window():
    assert substrings.prefix_lengths(20, 8) == [8, 14, 17, 19, 20]
    assert substrings.prefix_lengths(5, 8) == [5]


@pytest.mark.parametrize("group", [1, 3, 50])
def test_a_common_passage_and_a_common_phrase_in_groups_of_any_size(spark, group):
    passage, phrase = prose(70, 45), prose(71, 9)
    rows = [(i, f"{prose(200 + i, 30)} {passage if i % 3 else phrase} {prose(300 + i, 25)}") for i in range(90)]
    rows += [(100, " ".join(["la"] * 200)), (101, " ".join(["la"] * 30))]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), group_segments=group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute_removed(rows, 20)


def test_a_null_id_has_no_component_even_among_copies(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (None, 0, None, True)], key=str)
