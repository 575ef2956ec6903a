"""op3 keeps distinct terms distinct, however long the texts."""

from collections import Counter

import pytest

from loomtext.llm import fingerprint


def jaccard(one, other):
    a, b = Counter(one.split()), Counter(other.split())
    return sum((a & b).values()) / sum((a | b).values())


def test_long_texts_against_exact_generalised_jaccard(spark):
    text = lambda name, n, often=1: " ".join(f"{name}{k:05d}" for k in range(n) for _ in range(1 + (often > 1 and k % often)))
    rows = [(1, text("a", 20_000)), (2, text("b", 20_000)), (3, text("c", 20_000)), (4, text("c", 20_000, 3)), (5, text("c", 10_000) + " " + text("d", 10_000))]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        assert found[i]["near_next"] == pytest.approx(jaccard(t, after), abs=0.02 if not jaccard(t, after) else 0.2)
        assert found[i]["near_edited"] == pytest.approx(jaccard(t, t[: n - n // 4] + after[: n // 4]), abs=0.2)
    assert [jaccard(rows[k][1], rows[k + 1][1]) for k in (0, 1)] == [0, 0]
