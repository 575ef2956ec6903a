"""Mixing sources to target weights (6): a time-varying curriculum.

Each source has a weight schedule over training time; its integral gives the source's cumulative token demand. A copy of
a document begins at some token of its source's stream; inverting the demand there gives the training position at
which the copy is read. Documents are then range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm.common import cut, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Rows of a bucket of a source's stream that are summed in one task, about; a source of any size is summed bucket by bucket.
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 256

#: (time, weight) knots over training time 0..1 of each kind of source, relative to its mean weight; linear in between, so
#: that two knots at one time are a step. Sources of the first weight fade, those of the last grow, the rest stay level.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> and target, weight, rank (by code point from 0, null last).

    Weights share out the total; a target stops at max_repeats times its source's size and the excess is shared again
    by weight until none is above. That ends with min(cap, level x weight) for the one level at which the targets make
    up the total, so the sources are sorted by cap / weight and the level is read off where the next isn't capped any
    more. The table has one row for each source, which is what the unpartitioned windows hold.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(kinds, (F.col("rank") % n + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * max_repeats).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything, by_ratio = W.partitionBy(), W.orderBy("_ratio", "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    )
    # The first source, by ratio, that the level computed without its predecessors does not fill.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "rank", "_level"))).over(everything)["_level"]
    s = s.withColumn("_at", level)
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("weight")), F.col("_cap")).alias("target"), "weight", "rank")


def demand(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(share before, share behind, begin, weight at the begin, slope) of each piece: the schedule's integral, in shares of it all."""
    times, weights = zip(*schedule, strict=True)
    if times[0] != 0 or times[-1] != 1 or list(times) != sorted(times) or min(weights) < 0:
        raise ValueError(f"a schedule goes from time 0 to 1, with weights of 0 or more: {schedule}")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairwise(schedule)]
    total, before, pieces = sum(areas), 0.0, []
    if total <= 0:
        raise ValueError(f"a schedule wants something at some time: {schedule}")
    for ((t0, w0), (t1, w1)), area in zip(pairwise(schedule), areas, strict=True):
        if area > 0:
            pieces.append((before / total, (before + area) / total, t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
            before += area
    return pieces


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which a source has had that share (0..1) of its demand: the inverse of the schedule's integral.

    In a piece of weight w and slope m the demand since its begin is y = w t + m t^2 / 2, so t = 2 y / (w + sqrt(w^2 + 2 m y)).
    """
    found = None
    for before, behind, begin, weight, slope in demand(schedule):
        y = F.greatest(F.lit(0.0), F.least(share, F.lit(behind)) - before)
        root = F.sqrt(F.greatest(F.lit(0.0), weight * weight + 2 * slope * y))
        t = begin + F.when(y > 0, 2 * y / (weight + root)).otherwise(F.lit(0.0))
        found = F.when(share <= behind, t) if found is None else found.when(share <= behind, t)
    return F.least(F.lit(1.0), found.otherwise(t))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    schedules: tuple[Schedule, ...] = SCHEDULES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The mix of documents (doc_id, text, source): a row for each document, with the copies that are taken.

    weights are dealt to the sources in turn, and with each weight the schedule of the same place. Returns doc_id, source,
    size, source_size, target, copies, taken, positions (training time of each copy, 0..1) and _key (a hash of the row). Each source's documents stand in an order given by a hash of their doc_id and text; copy
    after copy, they make a stream, of which a copy is taken if its middle lies before the target. So a source's
    taken words differ from its target by half a document at most. Nulls: a null text has no words, a null source is
    a source of its own, a null doc_id is a value like others. Documents without words are taken once where the source
    is wanted at all; they count nothing. Equal rows share their place in the order, one after the other.
    """
    sized = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
            F.xxhash64(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"), F.col("source").cast("string")).alias("_key"),
        )
    )
    # The leading bits of the key: however many there are, the order is that of the whole key.
    bits = max(LEAST_BUCKETS, sized.count() // bucket_rows).bit_length() - 1
    sized = sized.withColumn("_b", F.shiftright("_key", 64 - bits))
    by_bucket = cut(sized.groupBy("source", "_b").agg(F.sum("size").alias("_n")))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, max_repeats)
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    table = (
        by_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .alias("b")
        .join(goal.alias("g"), F.expr("b.source <=> g.source"))
        .select(F.col("b.source").alias("_s"), F.col("_b").alias("_sb"), "_before", "source_size", "target", "rank")
    )
    in_bucket = W.partitionBy("source", "_b").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("_in", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(table, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
        .withColumn("_start", F.col("_before") + F.col("_in"))
    )
    middle = F.col("_start") + F.col("size") / 2.0
    # Copy k begins at k * source_size + start; it is taken if its middle lies before the target.
    copies = F.ceil((F.col("target") - middle) / F.greatest(F.col("source_size"), F.lit(1)))
    copies = F.when(F.col("size") == 0, F.when((F.col("target") > 0) | (F.col("source_size") == 0), 1).otherwise(0)).otherwise(
        F.least(F.lit(max_repeats), F.greatest(F.lit(0), copies))
    ).cast("int")
    share = lambda k: F.least(
        F.lit(1.0), F.coalesce((F.col("_start") + k * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
    )

    def position(at: Column) -> Column:
        kind = F.col("rank") % len(weights)
        found = time_of(at, schedules[-1])
        for k, schedule in enumerate(schedules[:-1]):
            found = F.when(kind == k, time_of(at, schedule)).otherwise(found)
        return found

    return (
        placed.withColumn("copies", copies)
        .withColumn("taken", F.col("copies").cast("long") * F.col("size"))
        .withColumn(
            "positions",
            F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(share(k)))).otherwise(
                F.array().cast("array<double>")
            ),
        )
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "positions", "_key")
    )


def curriculum(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """The documents (doc_id, text, source) in training order: each row as often as mix() takes it, range-sorted by position.

    Rows are matched by doc_id and the hash of doc_id, text and source that mix() gives them. Rows that agree in these are
    numbered by their other columns, so that each has the copies and positions of one row of mix(). Nulls are values like
    others; an empty table gives no rows; columns are those that are returned.
    """
    once = mix(docs, **how).groupBy(F.col("_key").alias("_k"), F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list("positions")).alias("_all"))
    named = docs.select(
        *[F.col(c).alias(f"_out_{c}") for c in columns],
        F.col("doc_id").cast("long").alias("_own"),
        F.xxhash64(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"), F.col("source").cast("string")).alias("_of"),
    )
    order = W.partitionBy("_of", "_own").orderBy(F.xxhash64(*[F.col(f"_out_{c}") for c in columns]))
    numbered = named.withColumn("_i", F.row_number().over(order))
    taken = numbered.join(once, (F.col("_of") == F.col("_k")) & F.col("_own").eqNullSafe(F.col("_d"))).withColumn("_position", F.explode(F.element_at("_all", F.col("_i"))))
    return taken.orderBy("_position", "_own", "_of").select(*[F.col(f"_out_{c}").alias(c) for c in columns])
