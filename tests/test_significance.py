"""The suite's tests and their blocks, and the trials of the null, on small cases."""

from collections import defaultdict

import pytest

from loomtext.operators import stats
from loomtext.operators.align import links_by_method
from loomtext.plans import catalog


def brute(links):
    """(test, block size) -> observed, blocks."""
    agree, spans = defaultdict(dict), defaultdict(lambda: defaultdict(set))
    for r in links:
        key = r["pair_id"], r["i"], r["ps"]
        agree[key][r["method"]] = min(agree[key].get(r["method"], 1), int(r["ps"] == r["pd"]))
        spans[r["pair_id"], r["pd"]][r["method"]].add(r["ps"])
    a = {k: v["length"] - v["diagonal"] for k, v in agree.items() if len(v) == 2}
    out = {("agreement", 1): (sum(a.values()) / len(a), len({(k[0], k[2]) for k in a}))}
    c = {k: (len(v["length"]) <= 1) - (len(v["diagonal"]) <= 1) for k, v in spans.items() if len(v) == 2}
    for size in (1, 5, 10):
        rank = defaultdict(int)
        blocks = set()
        for pair, _ in sorted(c):
            blocks.add((pair, rank[pair] // size))
            rank[pair] += 1
        out["refinement", size] = sum(c.values()) / len(c), len(blocks)
    return out


def test_suite_on_tables(spark, sf_dir):
    want = brute(links_by_method(spark, sf_dir).collect())
    got = {(r["test"], r["block_size"]): r for r in catalog.QUERIES["significance_suite"](spark, sf_dir).collect()}
    assert {k: (pytest.approx(r["observed"]), r["blocks"]) for k, r in got.items()} == want


def test_suite_on_a_long_pair(spark):
    rows = [("length", 1, i, i, i // 2, i // 2) for i in range(46)] + [("diagonal", 1, i, i + 1, i // 2, (i + 1) // 2) for i in range(46)] + [("length", 2, 0, 0, 0, 0), ("diagonal", 2, 0, 0, 0, 0)]
    links = spark.createDataFrame(rows, "method string, pair_id long, i long, j long, ps long, pd long")
    got = {(r["test"], r["block_size"]): r for r in stats.suite(links).collect()}
    assert {k: (pytest.approx(r["observed"]), r["blocks"]) for k, r in got.items()} == brute(links.collect())
    assert [got["refinement", s]["blocks"] for s in (1, 5, 10)] == [24, 6, 4]
    assert got["agreement", 1]["p_value"] < 0.01


def test_five_trials_of_the_null(spark, sf_dir):
    found = {r["trial"]: r["agreed"] for r in catalog.QUERIES["triangle_null"](spark, sf_dir).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    assert found[0] == catalog.QUERIES["triangle_null_once"](spark, sf_dir).collect()[0]["agreed"]
