"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, component: the smallest node reachable from each node that has a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each by minima over neighbours, which are
    pre-aggregated before they are shuffled; a step's links replace those before it in the checkpoint folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
        large = both.join(smallest, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(below, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(below.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct())
        new = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
