"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from loomtext.llm import treejoin

from .conftest import SCHEMA, edge_rows


def lowered(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def by_hand(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = lowered(text or "")
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    part = list(range(len(rows)))
    for i, (doc, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = doc is not None and doc == rows[j][0]
            if same_id or None not in (doc, rows[j][0]) and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {p: min((d for (d, _), q in zip(rows, part, strict=True) if q == p and d is not None), default=None) for p in set(part)}
    return sorted(((d, len(s), least[p] if d is not None else None) for (d, _), s, p in zip(rows, sets, part, strict=True)), key=str)


def planted(seed: int, n: int) -> list[tuple]:
    """Edits of a few texts, some with a passage that many share; some ids are repeated."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(15, 110))] for _ in range(3)]
    shared = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [rng.choice("abc")] if rng.random() < 0.6 else []
        rows.append((i if rng.random() < 0.97 else 5, " ".join(words + shared * (rng.random() < 0.3))))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent", "block"), [(1, 3, 90, 3_000), (3, 2, 60, treejoin.BLOCK)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, width, percent, block):
    monkeypatch.setattr(treejoin, "BLOCK", block)
    rows = planted(seed, 120) + [(i, t) for i, t, *_ in edge_rows() if t is None or len(t) < 5_000]
    got = treejoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, width, percent)


def test_odd_rows_extra_columns_and_no_rows(edge, nothing):
    got = treejoin.ngram_join(edge).collect()
    assert len(got) == len(edge_rows()) and SCHEMA.count("rep")
    whole = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert whole[3] == (0, 3) and whole[6] == (1, 6) and whole[1] == (118, 0) and whole[2][1] == 0 and whole[None][1] is None
    assert treejoin.ngram_join(nothing).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_the_trie_finds_all_links_of_two_blocks(percent):
    rng = np.random.default_rng(percent)
    base = rng.permutation(400)[:80]

    def block(first: int) -> treejoin.Sets:
        rows = []
        for i in range(40):
            own = np.unique(np.where(rng.random(80) < rng.choice([0, 0.02, 0.2]), rng.integers(0, 400, 80), base)[: rng.integers(1, 81)])
            own = own[np.lexsort((own, -(own % 7)))]
            rows.append((first + i, len(own) + int(rng.integers(0, 3)), first + i, own % 7, own))
        return treejoin.Sets(rows)

    left, right = block(0), block(100)
    n_places = treejoin.place_in_order(left, right)
    got = {(i, int(j)) for i, js in treejoin.trie_links(left, right, n_places, percent) for j in js}
    common = lambda i, j: len(np.intersect1d(left.grams[i], right.grams[j]))
    want = {(i, j) for i in range(40) for j in range(40) if treejoin.is_linked(common(i, j), left.sizes[i], right.sizes[j], percent)}
    assert got == want and (want or percent == 100)
