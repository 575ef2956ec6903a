"""Editions cut at anchors against the aligner of whole pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import align, anchors

SCHEMA = "pair_id long, side string, ord int, text string, votes int"


def edition(pair: int, seed: int, n: int, noise: float) -> list[tuple]:
    """Two sides of which some sentences are merged, left out or inserted; names tie most of them."""
    rng = random.Random(seed)
    src, dst = [], []
    for k in range(n):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 30))]
        other = [w.upper() + "x" * rng.randrange(2) for w in words]
        name = [f"Name{pair}k{k}"] if rng.random() > noise else []
        src.append(" ".join(words + name))
        if dst and rng.random() < 0.05:
            dst[-1] += " " + " ".join(other + name)
        else:
            dst.append(" ".join(other + name))
    return [(pair, side, k, t, 1) for side, ts in (("src", src), ("dst", dst)) for k, t in enumerate(ts)]


@pytest.mark.parametrize("spacing", [1, 7, 1000])
def test_beads_are_those_of_whole_pairs(spark, spacing):
    rows = [r for p in range(6) for r in edition(p, p, 20 + 25 * p, 0.3)]
    sides = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((r["pair_id"], r["i0"], r["i1"], r["j0"], r["j1"]) for r in anchors.align_editions(sides, spacing=spacing).collect())
    want = sorted((r["pair_id"], r["i0"], r["i1"], r["j0"], r["j1"]) for r in align.length_beads(sides).collect())
    assert got == want
    if spacing == 7:
        assert anchors.cuts_of(anchors.ties(anchors.positions(anchors.measured(sides))), spacing).count() > 20


def test_outcomes_and_odd_rows(spark):
    rows = [
        (1, "src", 0, "a", 1), (1, "dst", 0, "b", 1), (2, "dst", 0, "alone", 1), (3, "src", 0, "alone", 1), (4, "src", 0, "", 1), (4, "dst", 0, "x", 1), (5, "src", 0, None, 1), (5, "src", 1, "yes", 1), (5, "dst", 0, "yes", 1),
        (None, "src", 0, "a", 1), (6, "other", 0, "a", 1), *[(7, side, k, "x" * n, 1) for side, sizes in (("src", [52, 181, 27]), ("dst", [1813, 634, 1170])) for k, n in enumerate(sizes)],
    ]
    got: dict[int, set] = {}
    for r in anchors.align_editions(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["pair_id"], set()).add((r["outcome"], r["i1"], r["j1"]))
    assert got == {1: {("aligned", 1, 1)}, 2: {("no source text", None, None)}, 3: {("aligned", 1, 0)}, 4: {("no source text", None, None)}, 5: {("aligned", 2, 1)}, 7: {("no path", None, None)}}
    assert anchors.align_editions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrong_cuts_fall_back_to_the_whole_pair(spark):
    # The names tie sentences whose neighbourhoods are far too unlike to be aligned on their own.
    src, dst = [10, 10, 400, 400, 400, 10], [400, 400, 400, 10, 10, 10]
    rows = [(1, s, k, "x" * n + (f" N{k}" if k in (2, 3) else ""), 1) for s, sizes in (("src", src), ("dst", dst)) for k, n in enumerate(sizes)]
    sides = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["i0"], r["i1"], r["j0"], r["j1"]) for r in anchors.align_editions(sides, spacing=1).where("outcome = 'aligned'").collect())
    whole = sorted((r["i0"], r["i1"], r["j0"], r["j1"]) for r in align.length_beads(sides).collect())
    assert got and (got == whole or got[-1][1] == 6)


@pytest.mark.parametrize("seed", range(20))
def test_heaviest_chain(seed):
    rng = random.Random(seed)
    points = [(rng.randrange(6), rng.randrange(6), rng.randint(1, 4)) for _ in range(8)]
    points = list({p[:2]: p for p in points}.values())
    weight = {p[:2]: p[2] for p in points}
    rising = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
    best = max(sum(weight[p] for p in c) for n in range(1, len(points) + 1) for c in itertools.combinations(sorted(weight), n) if rising(c))
    chain = anchors.heaviest_chain(points)
    assert rising(chain) and sum(weight[p] for p in chain) == best


def test_near_copies_of_documents(spark, sf_dir):
    """Where the path of the whole pair passes all cuts, the beads are the same."""
    sides = anchors.copies_as_sides(spark, sf_dir)
    cuts: dict[int, set] = {}
    for r in anchors.cuts_of(anchors.ties(anchors.positions(anchors.measured(sides, F.array("text")))), 20).collect():
        cuts.setdefault(r["pair_id"], set()).add((r["i"], r["j"]))
    got, want = ({}, {})
    for beads, rows in ((got, anchors.align_editions(sides, F.array("text"), 20).where("outcome = 'aligned'").collect()), (want, align.length_beads(sides).collect())):
        for r in rows:
            beads.setdefault(r["pair_id"], []).append((r["i0"], r["i1"], r["j0"], r["j1"]))
    right = [p for p in want if cuts.get(p, set()) <= {(b[0], b[2]) for b in want[p]}]
    assert got.keys() == want.keys() and len(right) > 3 and any(cuts.get(p) for p in right)
    assert all(sorted(got[p]) == sorted(want[p]) for p in right)
    assert all(c in {(b[0], b[2]) for b in got[p]} for p, cs in cuts.items() for c in cs)
