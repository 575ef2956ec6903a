"""Edit scripts, unified diffs and the gate."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import diffs


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_scripts_are_right_and_shortest(seed):
    rng = random.Random(seed)
    letters = rng.choice([2, 3, 20])
    a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 25))] for _ in range(2))
    if seed % 3 == 0:
        b = [x for x in a if rng.random() < 0.9] + [1] * (seed % 4)
    script = diffs.edit_script(a, b)
    assert [a[i] for op, i, _ in script if op != "+"] == a and [b[j] for op, _, j in script if op != "-"] == b
    assert all(a[i] == b[j] for op, i, j in script if op == "=")
    assert sum(op == "=" for op, *_ in script) == common(a, b)


def pairs(spark):
    rng = random.Random(2)
    lines = ["same", "", "-- x", "++ y", "+++ b/odd", "@@ -1 +1 @@", "password = 'hunter2hunter2'", "last"]
    rows = [(k, [rng.choice(lines) for _ in range(rng.randint(0, 12))], [rng.choice(lines) for _ in range(rng.randint(1, 12))]) for k in range(40)]
    return rows + [(90, None, ["a"]), (91, ["a", None], ["a", ""]), (92, None, None), (93, ["x"] * 4000, ["x"] * 3999 + ["y"])]


def test_diffs_are_read_back(spark):
    rows = pairs(spark)
    scripts = diffs.edit_scripts(spark.createDataFrame(rows, "pair_id long, old array<string>, new array<string>").repartition(3))
    pair = F.col("pair_id").cast("string")
    made = {r["pair_id"]: r["diff"] for r in diffs.unified_diffs(scripts, pair, pair).collect()}
    parsed: dict[int, list] = {}
    for r in diffs.parse_diffs(diffs.unified_diffs(scripts, pair, pair)).collect():
        assert r["file"] == str(r["pair_id"])
        parsed.setdefault(r["pair_id"], []).append((r["op"], r["line"], r["text"]))
    stats = {r["pair_id"]: (r["added"], r["deleted"]) for r in diffs.numstat(scripts).collect()}
    for k, old, new in rows:
        old, new = [x or "" for x in old or []], [x or "" for x in new or []]
        if old == new:
            assert k not in made
            continue
        gone = sorted(line for op, line, _ in parsed[k] if op == "-")
        added = {line: text for op, line, text in parsed[k] if op == "+"}
        kept = iter([t for n, t in enumerate(old, 1) if n not in gone])
        assert [added[n] if n in added else next(kept) for n in range(1, len(new) + 1)] == new and next(kept, None) is None
        assert stats[k] == (len(added), len(gone))
        assert all(old[line - 1] == text for op, line, text in parsed[k] if op == "-")
        headers = sum(x.startswith("@@ ") and x.endswith(" @@") for x in made[k].split("\n"))
        assert headers >= 1 and (k != 93 or made[k] == "\n".join(x.rstrip("\n") for x in difflib.unified_diff(old, new, "a/93", "b/93", n=0, lineterm="")))


def test_gate(spark):
    rows = [("s", f"f{k}", k, 1) for k in range(9)] + [("s", "a/license/x", 999, 0), ("t", "blog1", 5, 5), ("u", "big", 400, 1), (None, "n", 1, 1)]
    got = {r[0]: tuple(r)[1:] for r in diffs.gate(spark.createDataFrame(rows, "source string, file string, added long, deleted long"), "source", 400, 8).collect()}
    assert got["s"] == (45, 9, 1, False, True, False, "9 f8; 8 f7; 7 f6; 6 f5; 5 f4")
    assert got["t"] == (0, 0, 1, False, False, True, "") and got["u"][3:6] == (True, False, False) and got[None] == (2, 1, 0, False, False, True, "2 n")


def test_secrets_in_added_lines(spark, sf_dir):
    got = [tuple(r) for r in diffs.edit_added_secrets(spark, sf_dir).collect()]
    docs = {str(r["doc_id"]): r["text"].split("\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()}
    assert all(kind in ("block", "warn") and docs[f][line - 1] for f, line, kind in got)
