"""Measures of alignments: agreement, refinement, coverage, common subsets, triangles.

The same SQL says them to Spark, over views that are bound to DataFrames, and to the oracle, over common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.operators.align import LINKS_SQL, links_by_method
from loomtext.plans.registry import query
from loomtext.sources.scratch import cut
from loomtext.sources.tables import conversation_sides

_SIZES = "(SELECT pair_id, count(*) FILTER (WHERE side = 'src') AS n, count(*) FILTER (WHERE side = 'dst') AS m FROM {sides} GROUP BY pair_id)"
_PAIRS = "(SELECT method, pair_id, n, m FROM " + _SIZES + " s CROSS JOIN (SELECT DISTINCT method FROM {links}) x)"
_COMMON_SRC = "(SELECT pair_id, i FROM {links} GROUP BY pair_id, i HAVING count(DISTINCT method) = 2)"
_COMMON_DST = "(SELECT pair_id, pd FROM {links} GROUP BY pair_id, pd HAVING count(DISTINCT method) = 2)"
_AGREE = "coalesce(CAST(sum(CASE WHEN ps = pd THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), CAST(0 AS DOUBLE))"
_VIOLATIONS = "(SELECT method, pair_id, pd, count(DISTINCT ps) AS k FROM {links} l GROUP BY method, pair_id, pd)"

#: Each over links (method, pair_id, i, j, ps, pd, cs, cd) and sides (pair_id, side, ord, turn, text).
MEASURES = {
    "expand_links": "SELECT method, pair_id, i, j FROM {links}",
    "coverage": "SELECT p.method, p.pair_id, CAST(count(DISTINCT l.i) AS DOUBLE) / max(n) AS src, CAST(count(DISTINCT l.j) AS DOUBLE) / max(m) AS dst FROM "
    + _PAIRS + " p LEFT JOIN {links} l ON p.method = l.method AND p.pair_id = l.pair_id GROUP BY p.method, p.pair_id",
    # Defined only where both sides have as many paragraphs.
    "paragraph_agreement": "SELECT l.method, l.pair_id, count(*) AS links, CASE WHEN max(ceil(n / 2.0)) = max(ceil(m / 2.0)) THEN " + _AGREE + " END AS rate FROM {links} l JOIN "
    + _SIZES + " s ON l.pair_id = s.pair_id GROUP BY l.method, l.pair_id",
    "agreement_common": "SELECT l.method, l.pair_id, count(*) AS links, " + _AGREE + " AS rate FROM {links} l LEFT SEMI JOIN " + _COMMON_SRC + " c ON l.pair_id = c.pair_id AND l.i = c.i GROUP BY l.method, l.pair_id",
    "refinement_violations": "SELECT method, pair_id, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS paragraphs FROM " + _VIOLATIONS + " v GROUP BY method, pair_id",
    "refinement_common": "SELECT method, v.pair_id, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS paragraphs FROM "
    + _VIOLATIONS + " v LEFT SEMI JOIN " + _COMMON_DST + " c ON v.pair_id = c.pair_id AND v.pd = c.pd GROUP BY method, v.pair_id",
    "covered_paragraphs": "SELECT DISTINCT method, pair_id, pd FROM {links}",
    # A source without links does not agree.
    "sentence_outcomes": "SELECT x.method, s.pair_id, CAST(s.ord AS BIGINT) AS i, CASE WHEN coalesce(bool_and(l.ps = l.pd), false) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS outcome "
    "FROM {sides} s CROSS JOIN (SELECT DISTINCT method FROM {links}) x LEFT JOIN {links} l ON l.method = x.method AND l.pair_id = s.pair_id AND l.i = s.ord WHERE s.side = 'src' GROUP BY x.method, s.pair_id, s.ord",
    # A target paragraph without links violates nothing.
    "refinement_outcomes": "SELECT x.method, d.pair_id, d.pd, CASE WHEN count(DISTINCT l.ps) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS outcome "
    "FROM (SELECT DISTINCT pair_id, CAST(floor(ord / 2) AS BIGINT) AS pd FROM {sides} WHERE side = 'dst') d CROSS JOIN (SELECT DISTINCT method FROM {links}) x "
    "LEFT JOIN {links} l ON l.method = x.method AND l.pair_id = d.pair_id AND l.pd = d.pd GROUP BY x.method, d.pair_id, d.pd",
    "cross_chapter_links": "SELECT method, count(*) AS links, CAST(sum(CASE WHEN cs <> cd THEN 1 ELSE 0 END) AS BIGINT) AS crossing FROM {links} GROUP BY method",
    "common_src": "SELECT pair_id, i FROM " + _COMMON_SRC + " c",
    "common_dst": "SELECT pair_id, pd FROM " + _COMMON_DST + " c",
    "links_in_chapter": "SELECT method, pair_id, i - 1 AS i, j - 1 AS j FROM {links} WHERE i >= 1 AND i < 3 AND j >= 1 AND j < 3",
    "monotone_links": "SELECT method, pair_id, bool_and(lo >= coalesce(p_lo, lo) AND hi >= coalesce(p_hi, hi)) AS monotone FROM (SELECT method, pair_id, lo, hi, "
    "lag(lo) OVER (PARTITION BY method, pair_id ORDER BY i) AS p_lo, lag(hi) OVER (PARTITION BY method, pair_id ORDER BY i) AS p_hi FROM "
    "(SELECT method, pair_id, i, min(j) AS lo, max(j) AS hi FROM {links} GROUP BY method, pair_id, i) a) b GROUP BY method, pair_id",
    "evaluate_all": "SELECT a.method, a.pair_id, a.links, a.matched, b.violations, b.paragraphs, c.src, c.dst FROM "
    "(SELECT method, pair_id, count(*) AS links, CAST(sum(CASE WHEN ps = pd THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM {links} GROUP BY method, pair_id) a "
    "JOIN (SELECT method, pair_id, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS paragraphs FROM " + _VIOLATIONS + " v GROUP BY method, pair_id) b "
    "ON a.method = b.method AND a.pair_id = b.pair_id JOIN (SELECT l.method, l.pair_id, CAST(count(DISTINCT l.i) AS DOUBLE) / max(n) AS src, CAST(count(DISTINCT l.j) AS DOUBLE) / max(m) AS dst FROM {links} l JOIN "
    + _SIZES + " s ON l.pair_id = s.pair_id GROUP BY l.method, l.pair_id) c ON a.method = c.method AND a.pair_id = c.pair_id",
    # The lower of two middle targets.
    "path_points": "SELECT method, pair_id, i, j FROM (SELECT method, pair_id, i, j, row_number() OVER (PARTITION BY method, pair_id, i ORDER BY j) AS k, count(*) OVER (PARTITION BY method, pair_id, i) AS n FROM {links}) x WHERE k = floor((n + 1) / 2)",
    "perm_blocks": "SELECT method, pair_id AS block, count(*) AS size, CAST(sum(CASE WHEN ps = pd THEN 1 ELSE 0 END) AS DOUBLE) AS agreeing FROM {links} GROUP BY method, pair_id",
}


def measure(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Aligning is by far the dearest part, so links that are read more than once are written first.
    links = lambda: cut(links_by_method(spark, sf_dir)) if MEASURES[name].count("{links}") > 1 else links_by_method(spark, sf_dir)
    views = {"links": links, "sides": lambda: conversation_sides(spark, sf_dir)}
    return spark.sql(MEASURES[name], **{k: v() for k, v in views.items() if "{" + k + "}" in MEASURES[name]})


for _name, _sql in MEASURES.items():
    _duck = _sql.format(links="links", sides="sides").replace("LEFT SEMI JOIN", "SEMI JOIN")
    query("WITH RECURSIVE " + LINKS_SQL + " " + _duck, _name)(lambda spark, sf_dir, name=_name: measure(name, spark, sf_dir))


@query(
    "WITH RECURSIVE "
    + LINKS_SQL
    + " SELECT method, pair_id, 'forward' AS direction, i AS k, string_agg(j, ',' ORDER BY j) AS partners FROM links GROUP BY ALL UNION ALL SELECT method, pair_id, 'backward', j, string_agg(i, ',' ORDER BY i) FROM links GROUP BY method, pair_id, j"
)
def link_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of each position, in order, both ways."""
    return spark.sql(
        "SELECT method, pair_id, 'forward' AS direction, i AS k, array_join(array_sort(collect_list(j)), ',') AS partners FROM {links} GROUP BY method, pair_id, i "
        "UNION ALL SELECT method, pair_id, 'backward', j, array_join(array_sort(collect_list(i)), ',') FROM {links} GROUP BY method, pair_id, j",
        links=links_by_method(spark, sf_dir),
    )
