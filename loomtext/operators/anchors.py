"""Aligning editions of any length: cut at certain points, align the parts in many tasks, join them again.

1. A feature (a token of a sentence) that occurs once on either side of a pair ties its two sentences together; what several
   features agree on has more votes. Of a pair's ties, the heaviest chain that rises on both sides is kept (ties are numbers, a
   few for each sentence; texts are not moved for it).
2. Where two neighbouring sentences are tied to two neighbouring ones, a path may be cut between them: so cuts go between
   links, never through a bead of more than one sentence. Cuts are thinned out to one every `spacing` sentences.
3. Each part is a row with the lengths of its sentences, and is aligned by itself with the ratio of the whole pair. A pair
   with a part that has no path is aligned as a whole, as its cuts may be wrong.
A part without cuts, however long, needs memory by the sum of its sides (see align.cheapest_path), but time by their product.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.functions import text as X
from loomtext.operators.align import ALIGNED, NO_SOURCE, alignments, length_arrays
from loomtext.plans.registry import query
from loomtext.sources.scratch import cut
from loomtext.sources.tables import sentences

SPACING = 200
#: Cells of the tables that one task fills, about.
TASK_CELLS = 10_000_000


def measured(texts: DataFrame, features: Column | None = None) -> DataFrame:
    """texts with n, the length of each, and features, as hashes, in place of the text: all that an alignment needs of it."""
    found = X.tokens(F.col("text")) if features is None else features
    return texts.withColumn("n", F.length("text")).withColumn("features", F.transform(F.array_distinct(found), lambda x: F.xxhash64(x))).drop("text")


def positions(sides: DataFrame) -> DataFrame:
    """sides (pair_id, side, ord and more) with pos, each text's place in its side, from 0."""
    return sides.withColumn("pos", (F.row_number().over(W.partitionBy("pair_id", "side").orderBy("ord")) - 1).cast("int"))


def ties(placed: DataFrame) -> DataFrame:
    """pair_id, i, j, votes: sentences that have features in common which occur once on either side."""
    each = placed.select("pair_id", "side", "pos", F.explode("features").alias("feature"))
    place = lambda s: F.min(F.when(F.col("side") == s, F.col("pos")))
    count = lambda s: F.count_if(F.col("side") == s)
    once = each.groupBy("pair_id", "feature").agg(place("src").alias("i"), place("dst").alias("j"), count("src").alias("_n"), count("dst").alias("_m")).where("_n = 1 and _m = 1")
    return once.groupBy("pair_id", "i", "j").agg(F.count(F.lit(1)).alias("votes"))


def heaviest_chain(points: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of points (i, j, weight), those of the heaviest chain in which both i and j rise."""
    ends: list[int] = []  # j of the best chains, rising, as their weights do
    best: list[tuple[int, int]] = []  # weight and point of the same
    before: list[int] = []
    order = sorted(range(len(points)), key=lambda k: (points[k][0], -points[k][1]))
    for k in order:
        _, j, weight = points[k]
        at = bisect_left(ends, j)
        total = weight + (best[at - 1][0] if at else 0)
        before.append(best[at - 1][1] if at else -1)
        if at < len(ends) and ends[at] == j and best[at][0] >= total:
            continue
        stop = at
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[at:stop], best[at:stop] = [j], [(total, len(before) - 1)]
    chain, k = [], best[-1][1] if best else -1
    while k >= 0:
        chain.append(points[order[k]][:2])
        k = before[k]
    return chain[::-1]


def cuts_of(tied: DataFrame, spacing: int) -> DataFrame:
    """pair_id, i, j: the first sentences of both sides behind each cut."""

    def run(batches):
        for batch in batches:
            found = []
            for pair, points in zip(batch["pair_id"], batch["points"], strict=True):
                last, chain = 0, heaviest_chain([(p["i"], p["j"], p["votes"]) for p in points])
                for (a, b), (c, d) in zip(chain, chain[1:], strict=False):
                    if c == a + 1 and d == b + 1 and c - last >= spacing:
                        found.append((pair, c, d))
                        last = c
            yield pd.DataFrame(found, columns=["pair_id", "i", "j"])

    points = tied.groupBy("pair_id").agg(F.collect_list(F.struct("i", "j", "votes")).alias("points"))
    return points.mapInPandas(run, "pair_id long, i int, j int")


def parts_of(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """pair_id, part, i0, j0 (first places), src, dst (lengths), ratio (of the pair) of each part between cuts."""
    marks = cuts.select("pair_id", F.lit("src").alias("side"), F.col("i").alias("pos"), F.lit(1).alias("_mark")).unionByName(cuts.select("pair_id", F.lit("dst").alias("side"), F.col("j").alias("pos"), F.lit(1).alias("_mark")))
    rows = placed.select("pair_id", "side", "pos", "n").join(marks, ["pair_id", "side", "pos"], "left")
    rows = rows.withColumn("part", F.count("_mark").over(W.partitionBy("pair_id", "side").orderBy("pos")).cast("int"))
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    lengths = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "n")))), lambda x: x["n"])
    parts = rows.groupBy("pair_id", "part").agg(
        F.min(of("src", "pos")).alias("i0"), F.min(of("dst", "pos")).alias("j0"), lengths("src").alias("src"), lengths("dst").alias("dst"), F.sum(of("src", "n")).alias("_s"), F.sum(of("dst", "n")).alias("_d")
    )
    whole = parts.groupBy("pair_id").agg((F.coalesce(F.sum("_d"), F.lit(0)) / F.nullif(F.sum("_s"), F.lit(0))).alias("ratio"))
    return parts.drop("_s", "_d").join(whole, "pair_id")


def align_editions(sides: DataFrame, features: Column | None = None, spacing: int = SPACING) -> DataFrame:
    """Beads of pairs of any length, by the length model: pair_id, outcome, i0, i1, j0, j1.

    sides: pair_id, side (src, dst), ord, text, or in place of text what measured() makes of it. features: an array for each
    row, its words unless it is given. A pair that
    can't be aligned is one row with its outcome and no bounds; so is one without source text, or without either side. Where
    the ties are right, the beads are those that aligning the whole pair gives. Rows of a null pair_id are left out; null
    texts have no length and no features; equal ords stand in any order.
    """
    lean = sides if "features" in sides.columns else measured(sides, features)
    placed = cut(positions(lean.where("pair_id is not null and side in ('src', 'dst')").select("pair_id", "side", "ord", "n", "features")))
    parts = cut(parts_of(placed, cuts_of(ties(placed), spacing)))
    usable = parts.where("ratio is not null")
    cells = usable.agg(F.sum((F.size("src") + 1).cast("double") * (F.size("dst") + 1))).first()[0] or 0
    # Parts are small rows that take long: they are dealt by the time they take, not by their bytes.
    done = cut(alignments(usable.repartition(max(1, math.ceil(cells / TASK_CELLS)))))
    failed = done.where(F.col("outcome") != ALIGNED).select("pair_id").distinct()
    several = failed.join(parts.where("part > 0").select("pair_id").distinct(), "pair_id", "left_semi")
    again = alignments(length_arrays(placed.join(several, "pair_id", "left_semi").drop("features")))
    kept = done.join(several, "pair_id", "left_anti").select("pair_id", "outcome", F.coalesce("i0", F.lit(0)).alias("_i"), F.coalesce("j0", F.lit(0)).alias("_j"), "beads")
    both = kept.unionByName(again.select("pair_id", "outcome", F.lit(0).alias("_i"), F.lit(0).alias("_j"), "beads"))
    beads = both.where(F.col("outcome") == ALIGNED).select("pair_id", "outcome", "_i", "_j", F.explode("beads").alias("b"))
    placed_beads = beads.select("pair_id", "outcome", *[(F.col(f"b.{c}") + F.col(s)).alias(c) for c, s in (("i0", "_i"), ("i1", "_i"), ("j0", "_j"), ("j1", "_j"))])
    nothing = [F.lit(None).cast("int").alias(c) for c in ("i0", "i1", "j0", "j1")]
    unaligned = both.where(F.col("outcome") != ALIGNED).select("pair_id", "outcome").distinct()
    without = parts.where("ratio is null").select("pair_id", F.lit(NO_SOURCE).alias("outcome")).distinct()
    return placed_beads.unionByName(unaligned.unionByName(without).select("pair_id", "outcome", *nothing))


def copies_as_sides(spark: SparkSession, sf_dir: str, lean: bool = False) -> DataFrame:
    """Sentences of documents that begin alike: src is the first (by doc_id) with that sentence at its head, dst each other one.

    lean: what measured() makes of them, tied by whole sentences, so that no text is copied to the pairs.
    """
    texts = sentences(spark, sf_dir).select("doc_id", F.struct("par", "sent").alias("ord"), "text")
    heads = texts.where("ord.par = 1 and ord.sent = 1").select("doc_id", F.xxhash64("text").alias("head"))
    texts = measured(texts, F.array("text")) if lean else texts
    rest = [c for c in texts.columns if c != "doc_id"]
    first = heads.groupBy("head").agg(F.min("doc_id").alias("first"))
    pairs = cut(heads.join(first, "head").where("doc_id > first").select(F.col("doc_id").alias("pair_id"), "first"))
    dst = texts.join(pairs, F.col("doc_id") == F.col("pair_id")).select("pair_id", F.lit("dst").alias("side"), *rest)
    src = texts.join(pairs, F.col("doc_id") == F.col("first")).select("pair_id", F.lit("src").alias("side"), *rest)
    return src.unionByName(dst)


@query()
def align_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beads between near copies of documents, tied by whole sentences. tests/test_anchors.py holds them against the aligner of whole pairs."""
    return align_editions(copies_as_sides(spark, sf_dir, lean=True))
