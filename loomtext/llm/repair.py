"""Conversation structure repair (12): a fold over each conversation's turns, written in Spark's higher-order functions.

Windows flag each turn's first fault; a conversation's turns are collected as sorted structs; aggregate() walks over them
and carries four structs (cost, audit), the cheapest edits that lead to each state of `(s?(ua)+)?`: nothing yet, behind
the s, behind a u, behind an a. least() picks by cost and then by audit.

An audit has a letter for each edit. Two audits of the same turns and the same cost never begin with each other (the longer
one would have more insertions and cost more), so the lesser of two stays the lesser whatever follows both, and the fold
needs to keep one for each state. While it runs, letters also tell which role an edit gives (I and J insert user and
assistant, R and S rerole to them); they stand in the same order as I and R among the others, so least() is not
misled, and the repaired turns can be read off the audit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANKS = r"\x20\x09-\x0D"
_STATE = "struct<cost:bigint,audit:string>"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: each row damaged by crc32 of `conv_id:turn`, modulo 20.

    0 loses the row (it stays, flagged), 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 makes its role user.
    Nulls in role and text, and in the ids of the key, count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).cast("int").alias("_kind"),
    )
    kind = F.col("_kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with fault: blank, duplicate, truncated or none, the first that holds. All turns of a conversation share a partition."""
    same = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    dealt = rows.repartition("conv_id").withColumn("_same", same)
    earlier = F.row_number().over(W.partitionBy("conv_id", "lost", "_same").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{_BLANKS}]"), "blank")
        .when(earlier, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{_BLANKS}]*\z"), "truncated")
        .otherwise("none")
    )
    return dealt.withColumn("fault", fault).drop("_same")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edited(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _states(empty: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(*[x.cast(_STATE).alias(n) for x, n in ((empty, "empty"), (s, "s"), (u, "u"), (a, "a"))])


def _inserted(at: Column) -> Column:
    """States that insertions reach. More than two in a row lead to no state that fewer don't."""
    u = F.least(at["u"], _edited(F.least(at["empty"], at["s"], at["a"]), INSERT, "I"))
    return _let(u, lambda u: _states(at["empty"], at["s"], u, F.least(at["a"], _edited(u, INSERT, "J"))))


def _stepped(at: Column, turn: Column) -> Column:
    """States behind one turn, before insertions."""
    stays = ~turn["fault"].isin("blank", "duplicate")
    pay = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def become(state: Column, initial: str, rerole: str) -> Column:
        kept = turn["initial"] == initial
        return F.when(stays, _edited(state, pay + F.when(kept, 0).otherwise(REROLE), F.when(kept, "K").otherwise(rerole)))

    gone = {n: _edited(at[n], DELETE, "D") for n in ("empty", "s", "u", "a")}
    return _states(
        gone["empty"],
        F.least(gone["s"], F.when(stays & (turn["initial"] == "s"), _edited(at["empty"], pay, "K"))),
        F.least(gone["u"], become(F.least(at["empty"], at["s"], at["a"]), "u", "R")),
        F.least(gone["a"], become(at["u"], "a", "S")),
    )


def _cheapest(turns: Column) -> Column:
    """(cost, audit) of an array of turns (initial, fault)."""
    nothing = F.lit(None).cast(_STATE)
    start = _inserted(_states(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")), nothing, nothing, nothing))
    return F.aggregate(turns, start, lambda at, turn: _let(_stepped(at, turn), _inserted), lambda at: F.least(at["empty"], at["a"]))


def _turn(role: Column | str, text: Column | str) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((role, "role"), (text, "text"))])


def _repaired(turns: Column, audit: Column) -> Column:
    """Turns (role, text) after the edits: the audit falls into one piece for each turn, insertions before it and its own letter."""
    pieces = F.regexp_extract_all(audit, F.lit(r"[IJ]*[DKRS]|[IJ]+$"), F.lit(0))
    none = F.array().cast("array<struct<role:string,text:string>>")

    def apply(piece: Column, i: Column) -> Column:
        own = F.right(piece, F.lit(1))
        letters = F.filter(F.split(piece, ""), lambda x: x.isin("I", "J"))
        text = F.get(turns, i)["text"]
        changed = F.when(own == "K", F.array(_turn(F.get(turns, i)["role"], text))).when(own == "R", F.array(_turn("user", text))).when(own == "S", F.array(_turn("assistant", text))).otherwise(none)
        return F.concat(F.transform(letters, lambda x: _turn(F.when(x == "I", "user").otherwise("assistant"), "")), changed)

    return F.flatten(F.transform(pieces, apply))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns of each conversation; rows: conv_id, turn, role, text and maybe lost.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit (K keep, R rerole, D delete, I insert) and
    repaired (array of role, text). Turns are taken by turn, nulls first, ties by role and text; equal rows of one turn stand
    together. Null roles and texts count as one space. A null conv_id is a conversation of its own. A conversation whose
    rows are all lost has zeros, an empty audit and nothing repaired. Other columns are ignored; an empty table gives no rows.
    A conversation has to fit in a row, as its turns are collected; the fold copies audits, so it takes time by the square of
    a conversation's turns, at a byte for each pair.
    """
    space = F.lit(" ")
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        lost.alias("lost"),
    )
    known = F.col("turn").isNotNull()
    one = F.struct(
        known.alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", (F.col("fault") == "duplicate").alias("again"), "fault", F.substring("role", 1, 1).alias("initial")
    )
    turns = flagged(clean).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("lost"), one))).alias("turns"))
    numbers = F.transform(F.filter("turns", lambda t: t["known"]), lambda t: t["turn"])
    pairs = F.filter(F.transform("turns", lambda t, i: F.concat(F.get(F.col("turns"), i - 1)["initial"], t["initial"])), lambda p: p.isNotNull())
    count = lambda fault: F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")
    told = turns.select(
        "conv_id",
        "turns",
        F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long").alias("gaps"),
        *[count(x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        _cheapest(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault")))).alias("_best"),
    )
    return told.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"),
        F.translate("_best.audit", "JS", "IR").alias("audit"), _repaired(F.col("turns"), F.col("_best.audit")).alias("repaired"),
    )


def repaired_digest(repaired: Column) -> Column:
    """SHA-256 of the repaired turns as lines `role:text`."""
    lines = F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
