"""Invariants of the library's own tables, checked as they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.operators.align import LENGTH_SQL, PRIORS, length_beads
from loomtext.plans.registry import query
from loomtext.sources.contracts import report, write_checked
from loomtext.sources.scratch import Scratch
from loomtext.sources.tables import SENTENCES_SQL, conversation_sides, sentences

_SHAPES = ", ".join(f"'{i}-{j}'" for i, j in PRIORS)


@query(
    "WITH RECURSIVE "
    + LENGTH_SQL
    + f""", _o AS (SELECT pair_id, b, row_number() OVER (PARTITION BY pair_id ORDER BY b[2] + b[4]) AS k FROM beads),
_w AS (SELECT *, coalesce(lag(b[2]) OVER w, 0) AS i, coalesce(lag(b[4]) OVER w, 0) AS j, lead(k) OVER w IS NULL AS is_last FROM _o WINDOW w AS (PARTITION BY pair_id ORDER BY k)),
_x AS (SELECT w.*, n, m FROM _w w JOIN _p USING (pair_id))
SELECT 'shape is known' AS rule, count(*) FILTER (WHERE concat(b[2] - b[1], '-', b[4] - b[3]) NOT IN ({_SHAPES})) AS violations FROM _x
UNION ALL SELECT 'source is tiled', count(*) FILTER (WHERE b[1] <> i) FROM _x UNION ALL SELECT 'target is tiled', count(*) FILTER (WHERE b[3] <> j) FROM _x
UNION ALL SELECT 'last bead ends both sides', count(*) FILTER (WHERE is_last AND (b[2] <> n OR b[4] <> m)) FROM _x"""
)
def contract_beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beads are of known shapes and tile both sides; counted while they are written."""
    sides = conversation_sides(spark, sf_dir)
    sizes = sides.groupBy("pair_id").agg(F.count_if(F.col("side") == "src").alias("n"), F.count_if(F.col("side") == "dst").alias("m"))
    pair = W.partitionBy("pair_id").orderBy("bead")
    before = lambda c: F.coalesce(F.lag(c).over(pair), F.lit(0))
    rows = length_beads(sides).withColumns({"_i": before("i1"), "_j": before("j1"), "_last": F.lead("bead").over(pair).isNull()}).join(sizes, "pair_id")
    rules = {
        "shape is known": F.concat_ws("-", F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0")).isin([f"{i}-{j}" for i, j in PRIORS]),
        "source is tiled": F.col("i0") == F.col("_i"),
        "target is tiled": F.col("j0") == F.col("_j"),
        "last bead ends both sides": ~F.col("_last") | (F.col("i1") == F.col("n")) & (F.col("j1") == F.col("m")),
    }
    return report(spark, write_checked(rows, f"{Scratch(spark).base}/beads", rules))


@query(
    "WITH "
    + SENTENCES_SQL
    + """, _s AS (SELECT *, lag(sent) OVER (PARTITION BY doc_id, par ORDER BY sent) AS p FROM sentences) SELECT 'has text' AS rule, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS violations FROM _s
UNION ALL SELECT 'follows the one before', count(*) FILTER (WHERE sent <> coalesce(p, 0) + 1) FROM _s UNION ALL SELECT 'some sentences', CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM _s"""
)
def contract_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences have text and are numbered without gaps, and there are some."""
    rows = sentences(spark, sf_dir).withColumn("_p", F.lag("sent").over(W.partitionBy("doc_id", "par").orderBy("sent")))
    rules = {"has text": F.trim("text") != "", "follows the one before": F.col("sent") == F.coalesce("_p", F.lit(0)) + 1}
    return report(spark, write_checked(rows, f"{Scratch(spark).base}/sentences", rules, {"some sentences": F.count(F.lit(1)) > 0}))
