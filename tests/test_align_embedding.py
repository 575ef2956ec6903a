"""align_embedding takes all vectors of both labels."""

import itertools

import numpy as np
import pytest

from loomtext.operators import align
from loomtext.plans import catalog


def brute_links(a, b):
    """Best monotone path cell by cell; a merged side is the sum of its two unit vectors."""
    unit = lambda v: v / np.linalg.norm(v)
    a, b = [unit(v) for v in a], [unit(v) for v in b]
    base = np.mean([x @ y for x in a for y in b])
    best = {(0, 0): (0.0, ())}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        for di, dj in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 0), (0, 1)):
            if i >= di and j >= dj:
                gain = float(unit(sum(a[i - di : i])) @ unit(sum(b[j - dj : j])) - base) if di and dj else 0.0
                total, path = best[i - di, j - dj]
                if (i, j) not in best or total + gain > best[i, j][0]:
                    best[i, j] = (total + gain, (*path, (i - di, i, j - dj, j)))
    return sorted((i, j) for i0, i1, j0, j1 in best[len(a), len(b)][1] for i in range(i0, i1) for j in range(j0, j1))


@pytest.mark.parametrize(("n", "m"), [(33, 41), (28, 12)])
def test_whole_labels_against_brute_force(spark, tmp_path, n, m):
    rng = np.random.default_rng(n)
    path = np.cumsum(rng.normal(size=(max(n, m), 6)), 0)
    sides = [path[:n] + rng.normal(size=(n, 6)), path[:m] + rng.normal(size=(m, 6))]
    rows = [(1000 * (k == 1) + i, k, v.tolist()) for k, s in enumerate(sides) for i, v in enumerate(s)] + [(9999, 2, [1.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r["i"], r["j"]) for r in catalog.QUERIES["align_embedding"](spark, str(tmp_path)).collect())
    assert got == brute_links(*sides)
    assert max(i for i, _ in got) >= 20


def test_tiles_give_the_path_of_the_whole_table(spark, monkeypatch):
    rng = np.random.default_rng(4)
    path = np.cumsum(rng.normal(size=(41, 6)), 0)
    sides = [path[:33] + rng.normal(size=(33, 6)), path + rng.normal(size=(41, 6))]
    rows = [(1000 * k + i, k, v.tolist()) for k, s in enumerate(sides) for i, v in enumerate(s)]
    monkeypatch.setattr(align, "TILE", 16)  # 3 x 3 tiles, the last with one source
    got = sorted(map(tuple, align.vector_beads(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0, 1).collect()))
    assert got == [b for b in align.align_vectors(*sides) if b[1] > b[0] and b[3] > b[2]]


@pytest.mark.parametrize("size", [2, 5, 64])
def test_edges_of_tiles_carry_the_whole_table(size):
    rng = np.random.default_rng(size)
    a, b = align.unit(rng.normal(size=(13, 4))), align.unit(rng.normal(size=(11, 4)))
    behind = lambda v, k: np.concatenate([v[max(k - 1, 0) : k] if k else v[:1], v[k : k + size]])
    whole = align.fill_tile(np.concatenate([a[:1], a]), np.concatenate([b[:1], b]), None, None, 0.1)[0]
    made = {}
    for i, j in itertools.product(range(0, 13, size), range(0, 11, size)):
        top, left = made.get((i - size, j)), made.get((i, j - size))
        made[i, j] = t = align.fill_tile(behind(a, i), behind(b, j), None if top is None else top[-2:], None if left is None else left[2:, -2:], 0.1)[0]
        assert t == pytest.approx(whole[i : i + size + 2, j : j + size + 2], abs=1e-12)
