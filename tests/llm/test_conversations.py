"""The conversation trie and structure repair against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.llm import repair, trie
from loomtext.llm.conversation_sql import REPAIR_SQL, TRIE_SQL

from ..oracle import rows as shown

SCHEMA = "conv_id long, turn long, role string, text string, name int, place string"


def made(seed: int, n: int, ids: range, texts: list) -> list[tuple]:
    rng = random.Random(seed)
    found = []
    for c in rng.sample(ids, n):
        for t in range(rng.randint(1, 11)):
            found.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice(texts), 1, "x"))
    return found + [(7, 3, "user", "long " * 20_000, 1, "x"), (8, 3, "user", "long " * 20_000, 1, "x")]


def nodes_by_hand(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, role or "", key, text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(turns.get(base, [])[:h] + t[h:])
    nodes: dict[tuple, list[int]] = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids: dict[tuple, list] = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums: dict[tuple, tuple[int, int]] = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(path, [])]
        saved = (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        sums[path] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + saved)
    sha = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(nodes[path]) if full[c] == path).encode()).hexdigest()
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], sha(p)) for p, m in nodes.items()]


@pytest.mark.parametrize(("seed", "range_turns", "run_turns"), [(1, 20_000, 200_000), (2, 9, 7), (3, 60, 25)])
def test_trie_is_that_of_brute_force(spark, seed, range_turns, run_turns):
    rows = [*made(seed, 60, range(-20, 160), ["a", "b", None, "", "ö"]), (None, 1, "user", "x", 1, "x")]
    rows += [(c, t, "user", "copy", 1, "x") for c in range(1000, 1040) for t in range(9)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = trie.prefix_trie(trie.fork_heads(turns), range_turns, run_turns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(nodes_by_hand(rows), key=str)


def test_trie_of_nothing_and_of_conversations_as_they_are(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 1, "user", "a", 1, "x"), (1, 2, "assistant", "b", 1, "x"), (2, 1, "user", "a", 1, "x")]
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:7] for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), None).collect()}
    assert got == {(1, 0): (None, 2, 1, 1, 1), (1, 1): (1, 2, 1, 1, 1), (1, 2): (1, 1, 0, 1, 0)}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_merge_gives_sorted_paths_and_their_common_turns(k):
    rng = random.Random(k)
    paths = sorted({b"".join(bytes([rng.randint(0, 2)]) * trie.DIGEST for _ in range(rng.randint(0, 6))) for _ in range(120)})
    runs: list[list] = [[] for _ in range(k)]
    for p in paths:
        run = rng.choice(runs)
        run.append((trie.common(run[-1][1], p) if run else 0, p))
    merged = list(trie.merge_runs([r for r in runs if r]))
    assert [row[1] for _, row in merged] == paths
    assert [lcp for lcp, _ in merged] == [0, *(trie.common(a, b) for a, b in zip(paths, paths[1:], strict=False))]


def edits_by_hand(turns: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """The cheapest of all edits of turns (role, text, fault), with two insertions in one place at most."""
    best = None

    def go(i: int, cost: int, audit: str, out: list[tuple[str, str]], inserted: int) -> None:
        nonlocal best
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                found = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
                best = found if best is None else min(best, found)
            return
        role, text, fault = turns[i]
        go(i + 1, cost + 2, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            pay = 5 * (fault == "truncated")
            go(i + 1, cost + pay, audit + "K", [*out, (role, text)], 0)
            for new in ("user", "assistant"):
                go(i + 1, cost + pay + 1, audit + "R", [*out, (new, text)], 0)

    go(0, 0, "", [], 0)
    return best


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", " ", "Once more. "]), 1, "x") for c in range(60) for t in range(rng.randint(1, 4))]
    got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).withColumn("sha", repair.repaired_digest(F.col("repaired"))).collect()
    for r in got:
        seen, turns = set(), []
        for _, _, role, text, *_ in (x for x in rows if x[0] == r["conv_id"]):
            fault = "blank" if not text.strip() else "duplicate" if (role, text) in seen else "truncated" if text.strip()[-1] not in ".!?" else "none"
            seen.add((role, text))
            turns.append((role, text, fault))
        assert (r["cost"], r["audit"], r["sha"]) == edits_by_hand(turns)
        assert [r[x] for x in ("blank", "duplicate", "truncated")] == [sum(t[2] == x for t in turns) for x in ("blank", "duplicate", "truncated")]


def with_duckdb(rows: list[tuple], sql: str):
    import pandas as pd

    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "name", "place"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c = duckdb.connect()
    c.register("given", table)
    c.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    return c.sql(sql)


def test_both_queries_agree_with_sql_on_damaged_and_odd_rows(spark):
    rows = [*made(9, 40, range(-9, 120), ["One.", "two", "Three!\n", "  ", None, "", "漢字。", "Is it? "]), *[(5000, t, "user" if t % 2 else "assistant", f"Turn {t}.", 1, "x") for t in range(400)]]
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = repair.repair_conversations(repair.damage(given)).withColumn("repaired_sha256", repair.repaired_digest(F.col("repaired"))).drop("repaired")
    want = with_duckdb(rows, REPAIR_SQL)
    assert shown(got.columns, got.collect()) == shown(want.columns, want.fetchall())
    got, want = trie.conversation_trie(given), with_duckdb(rows, TRIE_SQL)
    assert shown(got.columns, got.collect()) == shown(want.columns, want.fetchall())


def test_repair_of_null_ids_of_nothing_and_of_lost_rows(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, 1, "x"), (1, 5, "user", "Gone.", 1, "x"), (2, 9, "user", "Hello.", 1, "x"), (2, None, "system", "Be kind.", 1, "x"), (2, 12, "assistant", "Hello!", 1, "x")]
    marked = spark.createDataFrame(rows, SCHEMA).withColumn("lost", F.expr("conv_id <=> 1"))
    got = {r["conv_id"]: r for r in repair.repair_conversations(marked).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", [])
    assert (got[None]["blank"], got[None]["audit"], got[None]["gaps"]) == (1, "D", 0)
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"], [t["role"] for t in got[2]["repaired"]]) == (2, 0, "KKK", ["system", "user", "assistant"])
