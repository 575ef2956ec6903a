"""Near-duplicates of a planted set whose buckets hold thousands of documents that are alike but mostly not linked."""

import random

import numpy as np
import pytest

from loomtext.llm import neardup

from .conftest import prose


def planted(seed: int, groups: int, strays: int):
    """Links (a, b) that a text and its copy have, and rows; all are edits of one text, most by too much to be linked."""
    rng = random.Random(seed)
    base = prose(seed, 240).split()
    rows, links = [], []
    for k in range(strays):
        words = list(base)
        for at in rng.sample(range(240), rng.randrange(6, 16)):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    for k in range(groups):  # a copy of some of the strays, at a similarity of about 0.8 to 0.97
        a = rng.randrange(strays)
        words = rows[a][1].split()
        for at in rng.sample(range(240), rng.randrange(1, 7)):
            words[at] = f"c{k}x{at}"
        rows.append((strays + k, " ".join(words)))
        links.append((a, strays + k))
    return rows, links


def true_links(rows, width, percent):
    sets = [neardup.shingle_set(t.encode(), width) for _, t in rows]
    counts = neardup.shared_counts(sets, sets)
    n = np.array([len(s) for s in sets])
    linked = np.triu(neardup.is_linked(counts, n[:, None], n[None, :], percent), 1)
    return [(rows[i][0], rows[j][0]) for i, j in np.argwhere(linked)]


@pytest.mark.parametrize("percent", [80, 60])
def test_recall_on_a_mixed_bucket_of_thousands(spark, percent):
    rows, copies = planted(5, 300, 2200)
    want = true_links(rows, 5, percent)
    assert len(want) > 200
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).collect()}
    recall = sum(found[a] == found[b] for a, b in want) / len(want)
    print(f"percent {percent}: {len(want)} links, recall {recall:.4f}")
    assert recall >= 0.99
    # No link beyond the true ones: each component is connected by them.
    part = {i: i for i, _ in rows}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in want:
        part[root(a)] = root(b)
    assert all(root(i) == root(c) for i, c in found.items())


def test_shared_counts_against_sets():
    rng = np.random.default_rng(1)
    pools = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(90)] + [np.arange(10_000, 10_000 + k, dtype=np.uint64) for k in range(40)]
    left, right = pools[::2], pools[1::2]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup.shared_counts(left, right).tolist() == want


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 90, 95, 100])
def test_banding_follows_percent(percent):
    n, w = neardup.banding(percent)
    s = min(percent / 100, 0.99)
    assert 2 * (1 - s**w) ** n <= neardup.MISS
    assert n * n * s ** (2 * w) > 1


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows, _ = planted(6, 40, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    want = {tuple(r) for r in neardup.near_duplicates(df).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 8_000)
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == want


def test_rows_of_one_doc_id_with_different_texts(spark):
    a, b = prose(1, 100), prose(2, 100)
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == {(3, 3), (5, 3), (9, 3)}
