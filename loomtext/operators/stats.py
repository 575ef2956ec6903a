"""Paired block-permutation tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.operators.align import LINKS_SQL, links_by_method
from loomtext.plans.registry import query
from loomtext.sources.scratch import cut

#: Standard deviations that a distribution of signed sums is followed out to: beyond, less than 1e-300 is left.
REACH = 40.0
#: Products of two distributions of more cells than this are made by Fourier transforms, which are exact to 1e-15 only.
DIRECT = 1 << 34


def outcome_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block (pair), diff (sum over its sources of length model minus diagonal), size: sources that both methods link."""
    per = links_by_method(spark, sf_dir).groupBy("method", "pair_id", "i").agg(F.min((F.col("ps") == F.col("pd")).cast("double")).alias("o"))
    a, b = per.where("method = 'length'").alias("a"), per.where("method = 'diagonal'").alias("b")
    return a.join(b, F.expr("a.pair_id = b.pair_id and a.i = b.i")).groupBy(F.col("a.pair_id").alias("block")).agg(F.sum(F.col("a.o") - F.col("b.o")).alias("diff"), F.count("*").alias("size"))


def _signs(count: int) -> np.ndarray:
    """Probabilities of k minus signs of `count`, around the middle, for all k that REACH leaves."""
    from math import lgamma, log

    half = min(count, int(REACH * count**0.5) + 1)
    k = np.arange((count - half + 1) // 2, (count + half) // 2 + 1)
    return np.exp([lgamma(count + 1) - lgamma(x + 1) - lgamma(count - x + 1) - count * log(2) for x in k])


def signed_sums(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values and probabilities of the sum of whole numbers whose signs are drawn; counts: how often each size occurs.

    Numbers of one size are a scaled binomial, so a distribution is folded in for each different size, not for each number.
    """
    values, chances = np.zeros(1, np.int64), np.ones(1)
    variance = 0.0
    for size, count in sorted(counts.items()):
        if not size:
            continue
        own = _signs(count)
        variance += float(size) ** 2 * count
        spread = np.zeros(2 * size * (len(own) - 1) + 1)
        spread[:: 2 * size] = own
        if len(chances) * len(spread) <= DIRECT:
            chances = np.convolve(chances, spread)
        else:
            n = len(chances) + len(spread) - 1
            chances = np.maximum(np.fft.irfft(np.fft.rfft(chances, n) * np.fft.rfft(spread, n), n), 0)
        # Both are symmetric, so the middle stays 0.
        values = np.arange(len(chances)) - (len(chances) - 1) // 2
        near = np.abs(values) <= REACH * variance**0.5 + 1
        values, chances = values[near], chances[near]
    return values, chances


def exact(blocks: DataFrame, step: float = 1.0) -> DataFrame:
    """observed, p_value, blocks over all sign vectors of any number of blocks (diff, size), whose diffs are multiples of step.

    Only how often each |diff| occurs is brought to the task that folds the distribution. A diff that is no multiple of
    step is an error. No blocks, or none that has a size, give no row; null diffs and sizes count as 0.
    """
    units = F.coalesce(F.col("diff").cast("double"), F.lit(0.0)) / step
    rows = blocks.select(units.alias("_u"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("_size"))
    whole = F.when(F.abs(F.col("_u") - F.rint("_u")) > 1e-6, F.raise_error(F.lit(f"a difference is no multiple of {step}"))).otherwise(F.abs(F.rint("_u")).cast("long"))
    counted = rows.groupBy(whole.alias("units")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint("_u")).alias("total"), F.sum("_size").alias("size"))

    def run(batches):
        import pandas as pd

        found = pd.concat(list(batches))
        size = int(found["size"].sum()) if len(found) else 0
        if size:
            total = float(found["total"].sum())
            values, chances = signed_sums(dict(zip(found["units"].tolist(), found["n"].tolist(), strict=True)))
            extreme = np.abs(values * step / size) >= abs(total * step / size) - 1e-12
            yield pd.DataFrame({"observed": [total * step / size], "p_value": [min(1.0, chances[extreme].sum())], "blocks": [int(found["n"].sum())]})

    return counted.repartition(1).mapInPandas(run, "observed double, p_value double, blocks long")


#: Signs that one hash gives.
_BITS = 128


def monte_carlo(blocks: DataFrame, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """observed, p_value, iterations, blocks of blocks (block, diff, size): signs are drawn for each block; p counts the
    observed one too. No blocks give no row.

    The signs of a block are the bits of hashes of seed, block and iteration, so that each task sums its blocks' signed
    differences by itself, for all iterations, and nothing but those sums is brought together.
    """

    def run(batches):
        import hashlib

        import pandas as pd

        total = np.zeros(-(-iterations // _BITS) * _BITS)
        for b in batches:
            for block, diff in zip(b["block"], b["diff"], strict=True):
                raw = b"".join(hashlib.md5(f"{seed}:{block}:{k}".encode(), usedforsecurity=False).digest() for k in range(len(total) // _BITS))
                total += diff * (2.0 * np.unpackbits(np.frombuffer(raw, np.uint8)) - 1)
        yield pd.DataFrame({"iteration": np.arange(iterations), "x": total[:iterations]})

    rows = blocks.select(F.col("block").cast("string").alias("block"), F.col("diff").cast("double").alias("diff"), F.col("size").cast("long").alias("size"))
    sums = rows.select("block", "diff").mapInPandas(run, "iteration int, x double").groupBy("iteration").agg(F.sum("x").alias("x"))
    whole = rows.agg(F.sum("diff").alias("_diff"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("blocks")).where("blocks > 0")
    extreme = F.abs(F.col("x") / F.col("_size")) >= F.abs(F.col("_diff") / F.col("_size")) - 1e-12
    found = sums.join(F.broadcast(whole)).groupBy("_diff", "_size", "blocks").agg(F.count_if(extreme).alias("_n"))
    return found.select((F.col("_diff") / F.col("_size")).alias("observed"), ((F.col("_n") + 1) / F.lit(iterations + 1.0)).alias("p_value"), F.lit(iterations).alias("iterations"), "blocks")


def p_display(p: Column, iterations: Column | None = None) -> Column:
    """An exact p by six digits; a drawn one by five, and never as 0: what can't be resolved is said to be below that."""
    if iterations is None:
        return F.format_string("%.6f", p)
    least = 1.0 / (iterations + 1)
    return F.when(p <= least, F.concat(F.lit("< "), F.format_string("%.5f", least))).otherwise(F.format_string("%.5f", p))


def monte_carlo_sql(blocks: str, iterations: int = 10_000, seed: int = 0) -> str:
    """DuckDB: a SELECT of what monte_carlo() gives for a table of blocks (block as text, diff, size)."""
    return (
        f"SELECT d / z AS observed, (count(*) FILTER (WHERE abs(x / z) >= abs(d / z) - 1e-12) + 1) / {iterations + 1}.0::DOUBLE AS p_value, CAST({iterations} AS INT) AS iterations, blocks FROM "
        f"(SELECT it, sum(CASE WHEN ((strpos('0123456789abcdef', substr(h, CAST(k // 4 + 1 AS INT), 1)) - 1) >> CAST(3 - k % 4 AS INT)) & 1 = 1 THEN diff ELSE -diff END) AS x FROM "
        f"(SELECT diff, md5(concat('{seed}:', block, ':', c)) AS h, c, k, c * {_BITS} + k AS it FROM {blocks}, (SELECT unnest(range({-(-iterations // _BITS)})) AS c), (SELECT unnest(range({_BITS})) AS k)) WHERE it < {iterations} GROUP BY it), "
        f"(SELECT sum(diff) AS d, sum(size) AS z, count(*) AS blocks FROM {blocks}) GROUP BY d, z, blocks"
    )


_OUTCOMES_SQL = (
    "WITH RECURSIVE "
    + LINKS_SQL
    + """, o AS (SELECT method, pair_id, ps, i, min(CASE WHEN ps = pd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS o FROM links GROUP BY ALL),
u AS (SELECT a.pair_id, a.ps, a.o - b.o AS diff FROM o a JOIN o b ON a.method = 'length' AND b.method = 'diagonal' AND a.pair_id = b.pair_id AND a.i = b.i)"""
)


@query(
    _OUTCOMES_SQL
    + """, b AS (SELECT CAST(sum(diff) AS BIGINT) AS diff, count(*) AS size, row_number() OVER (ORDER BY pair_id) AS k FROM u GROUP BY pair_id),
w AS (SELECT CAST(sum(abs(diff)) AS BIGINT) AS reach, sum(diff) AS total, sum(size) AS size, count(*) AS n FROM b),
c AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(-reach, reach + 1), lambda x: CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM w
 UNION ALL SELECT b.k, list_transform(range(1, len(p) + 1), lambda x: (CASE WHEN x > abs(diff) THEN p[x - abs(diff)] ELSE 0.0::DOUBLE END + CASE WHEN x + abs(diff) <= len(p) THEN p[x + abs(diff)] ELSE 0.0::DOUBLE END) / 2) FROM c JOIN b ON b.k = c.k + 1)
SELECT total / size AS observed, (SELECT sum(x) FROM (SELECT unnest(p) AS x, unnest(range(-reach, reach + 1)) AS v) WHERE abs(v / size) >= abs(total / size) - 1e-12) AS p_value, n AS blocks FROM c, w WHERE c.k = w.n"""
)
def perm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact test of the length model against the diagonal, over all signs of all pairs' blocks."""
    return exact(outcome_blocks(spark, sf_dir))


@query(_OUTCOMES_SQL + ", b AS (SELECT CAST(pair_id AS VARCHAR) AS block, sum(diff) AS diff, count(*) AS size FROM u GROUP BY pair_id) " + monte_carlo_sql("b"))
def perm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monte_carlo(outcome_blocks(spark, sf_dir))


#: The level below which a difference counts.
LEVEL = 0.01


@query(
    _OUTCOMES_SQL
    + ", b AS (SELECT lpad(CAST(pair_id AS VARCHAR), 20, '0') || '/' || lpad(CAST(ps AS VARCHAR), 20, '0') AS block, sum(diff) AS diff, count(*) AS size FROM u GROUP BY pair_id, ps), m AS ("
    + monte_carlo_sql("b")
    + ") SELECT observed, p_value, CASE WHEN p_value <= 1.0 / 10001 THEN '< 0.00010' ELSE printf('%.5f', p_value) END AS p, blocks, observed > 0 AND p_value < 0.01 AS better FROM m"
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the length model, in attention's place, agrees better than the diagonal on the sources that both link."""
    units = agreement_units(cut(links_by_method(spark, sf_dir)))
    found = monte_carlo(_in_blocks(units, F.col("ps")))
    return found.select("observed", "p_value", p_display(F.col("p_value"), F.col("iterations")).alias("p"), "blocks", ((F.col("observed") > 0) & (F.col("p_value") < LEVEL)).alias("better"))


def _in_blocks(units: DataFrame, inside: Column) -> DataFrame:
    """block (pair and part of it), diff, size of units (pair_id, diff)."""
    return units.groupBy(F.format_string("%020d/%020d", F.col("pair_id").cast("long"), inside.cast("long")).alias("block")).agg(F.sum("diff").alias("diff"), F.count("*").alias("size"))


@query(
    "WITH RECURSIVE "
    + LINKS_SQL
    + """, d AS (SELECT method, pair_id, i, j, ps, pd FROM links WHERE method = 'length'), r AS (SELECT pair_id, j, row_number() OVER (PARTITION BY pair_id ORDER BY j) AS k, row_number() OVER (PARTITION BY pair_id ORDER BY md5(concat('20260906:', pair_id, ':', j))) AS s FROM (SELECT DISTINCT pair_id, j FROM d)),
t AS (SELECT a.pair_id, a.j, CAST(floor(b.j / 2) AS BIGINT) AS pd FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.k = b.s)
SELECT count(*) AS links, avg(CASE WHEN d.ps = d.pd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, avg(CASE WHEN d.ps = t.pd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS shuffled FROM d JOIN t ON t.pair_id = d.pair_id AND t.j = d.j"""
)
def shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the length model's links, and what is left of it when each pair's targets are dealt anew by a hash."""
    links = cut(links_by_method(spark, sf_dir).where("method = 'length'"))
    targets = links.select("pair_id", "j").distinct()
    of = W.partitionBy("pair_id")
    dealt = F.md5(F.concat(F.lit("20260906:"), F.col("pair_id").cast("string"), F.lit(":"), F.col("j").cast("string")))
    ranked = targets.withColumn("k", F.row_number().over(of.orderBy("j"))).withColumn("s", F.row_number().over(of.orderBy(dealt)))
    other = ranked.select(F.col("pair_id").alias("_p"), F.col("s").alias("_s"), F.floor(F.col("j") / 2).cast("long").alias("pd_new"))
    moved = ranked.join(other, (F.col("pair_id") == F.col("_p")) & (F.col("k") == F.col("_s"))).select(F.col("_p"), F.col("j").alias("_j"), "pd_new")
    both = links.join(moved, (F.col("pair_id") == F.col("_p")) & (F.col("j") == F.col("_j")))
    return both.agg(F.count(F.lit(1)).alias("links"), F.avg((F.col("ps") == F.col("pd")).cast("double")).alias("rate"), F.avg((F.col("ps") == F.col("pd_new")).cast("double")).alias("shuffled"))


def agreement_units(links: DataFrame) -> DataFrame:
    """pair_id, ps, diff of each source that both methods link: length model minus diagonal, 1 where all targets agree."""
    per = links.groupBy("pair_id", "ps", "i").agg(
        *[F.min(F.when(F.col("method") == m, (F.col("ps") == F.col("pd")).cast("double"))).alias(m) for m in ("length", "diagonal")]
    )
    return per.select("pair_id", "ps", (F.col("length") - F.col("diagonal")).alias("diff")).where("diff IS NOT NULL")


def refinement_units(links: DataFrame) -> DataFrame:
    """pair_id, k, diff of each target paragraph that both methods link, the k-th of its pair: 1 where one source paragraph at most reaches it."""
    per = links.groupBy("pair_id", "pd").agg(*[F.count_distinct(F.when(F.col("method") == m, F.col("ps"))).alias(m) for m in ("length", "diagonal")])
    common = per.where("length > 0 AND diagonal > 0")
    kept = lambda m: (F.col(m) <= 1).cast("double")
    k = F.row_number().over(W.partitionBy("pair_id").orderBy("pd")) - 1
    return common.select("pair_id", k.alias("k"), (kept("length") - kept("diagonal")).alias("diff"))


def suite(links: DataFrame) -> DataFrame:
    """test, block_size, and what monte_carlo gives: agreement in blocks of a source paragraph, refinement in blocks of 1, 5
    and 10 common target paragraphs. Blocks never reach over pairs. links: method, pair_id, i, j, ps, pd."""
    refinement = refinement_units(links)
    tests = [("agreement", 1, agreement_units(links), F.col("ps"))] + [("refinement", size, refinement, F.floor(F.col("k") / size)) for size in (1, 5, 10)]
    out = None
    for name, size, units, inside in tests:
        blocks = _in_blocks(units, inside)
        one = monte_carlo(blocks).select(F.lit(name).alias("test"), F.lit(size).alias("block_size"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_REFINED_SQL = """, v AS (SELECT pair_id, pd, count(DISTINCT CASE WHEN method = 'length' THEN ps END) AS a, count(DISTINCT CASE WHEN method = 'diagonal' THEN ps END) AS b FROM links GROUP BY ALL),
w AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pd) - 1 AS k, (CASE WHEN a <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN b <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS diff FROM v WHERE a > 0 AND b > 0),
x AS (SELECT 'agreement' AS test, 1 AS block_size, pair_id, ps AS part, diff FROM u UNION ALL SELECT 'refinement', z, pair_id, CAST(floor(k / z) AS BIGINT), diff FROM w, (VALUES (1), (5), (10)) s(z)),
y AS (SELECT test, block_size, lpad(CAST(pair_id AS VARCHAR), 20, '0') || '/' || lpad(CAST(part AS VARCHAR), 20, '0') AS block, sum(diff) AS diff, count(*) AS size FROM x GROUP BY ALL)"""


@query(
    _OUTCOMES_SQL
    + _REFINED_SQL
    + " "
    + " UNION ALL ".join(f"SELECT '{t}' AS test, CAST({z} AS INT) AS block_size, * FROM ({monte_carlo_sql(f'(SELECT * FROM y WHERE test = {t!r} AND block_size = {z})')})" for t, z in (("agreement", 1), ("refinement", 1), ("refinement", 5), ("refinement", 10)))
)
def significance_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and refinement of the length model against the diagonal; tests/test_significance.py holds the blocks."""
    return suite(cut(links_by_method(spark, sf_dir)))


@query(
    "WITH RECURSIVE "
    + LINKS_SQL
    + """, o AS (SELECT method, pair_id, i, min(CASE WHEN ps = pd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS o FROM links GROUP BY ALL)
SELECT a.pair_id AS block, sum(a.o - b.o) AS diff, count(*) AS size FROM o a JOIN o b ON a.method = 'length' AND b.method = 'diagonal' AND a.pair_id = b.pair_id AND a.i = b.i GROUP BY ALL"""
)
def paired_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_blocks(spark, sf_dir)
