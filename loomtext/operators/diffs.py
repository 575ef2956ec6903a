"""Edit scripts between documents and their near copies, as rows and as unified diffs, and the gate on what they change.

A pair is a row with both sides' lines, whose script one task makes by Myers' O(ND) search in linear space. All else is
relational: hunks are runs of changed lines, a unified diff is read back with running maxima over its lines, and the gate adds
up what changed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.functions import text as X
from loomtext.operators.relational import SECRET_BLOCK, SECRET_BLOCK_MORE, SECRET_WARN, SECRET_WARN_MORE
from loomtext.plans.registry import query
from loomtext.sources.scratch import cut
from loomtext.sources.tables import table

#: What the gate lets pass: changed lines and changed files; files that match are not counted.
MAX_LINES, MAX_FILES, EXEMPT = 400, 10, ("*/license/*", "blog*")


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (x0, y0, x1, y1), maybe empty, in the middle of a shortest script of two sides without a common end."""
    n, m = len(a), len(b)
    size = n + m + 3
    ahead, back = [0] * (2 * size), [0] * (2 * size)  # furthest x on each diagonal, from the begin and from the end
    for d in range((n + m + 1) // 2 + 1):
        for mine, other, turned in ((ahead, back, False), (back, ahead, True)):
            for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
                x = mine[size + k + 1] if k == -d or k != d and mine[size + k - 1] < mine[size + k + 1] else mine[size + k - 1] + 1
                x0, y = x, x - k
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if turned else a[x] == b[y]):
                    x, y = x + 1, y + 1
                mine[size + k] = x
                opposite = n - m - k
                # The other side has been to depth d if it moved first, else to d - 1.
                if abs(opposite) <= (d if turned else d - 1) and (opposite - d) % 2 == (0 if turned else 1) and x + other[size + opposite] >= n:
                    return (n - x, m - y, n - x0, m - (x0 - k)) if turned else (x0, x0 - k, x, y)
    raise AssertionError("two sides always meet")


def edit_script(a: list[int], b: list[int]) -> list[tuple[str, int, int]]:
    """A shortest script from a to b: (=, i, j), (-, i, j) and (+, i, j), in order; i and j are the places reached before."""
    out: list[tuple[str, int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(("=", a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - 1 - tail] == b[b1 - 1 - tail]:
            tail += 1
        if tail:
            stack.append((a1 - tail, a1, b1 - tail, b1))
            a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            out += [("-", i, b0) for i in range(a0, a1)] + [("+", a1, j) for j in range(b0, b1)]
            continue
        x0, y0, x1, y1 = _middle(a[a0:a1], b[b0:b1])
        # With ends that differ, the middle is neither corner, so both parts are smaller.
        stack += [(a0 + x1, a1, b0 + y1, b1), (a0 + x0, a0 + x1, b0 + y0, b0 + y1), (a0, a0 + x0, b0, b0 + y0)]
    return out


def edit_scripts(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, op (=, -, +), old_line, new_line (from 1, as far as reached), text; pairs: pair_id, old, new (arrays of lines).

    Null lines are empty ones; a null array has no lines. A pair without lines has no rows.
    """

    def run(batches):
        for b in batches:
            rows = []
            for pair, old, new in zip(b["pair_id"], b["old"], b["new"], strict=True):
                old, new = ([t or "" for t in (() if x is None else x)] for x in (old, new))
                code: dict[str, int] = {}
                one, two = ([code.setdefault(t, len(code)) for t in x] for x in (old, new))
                for seq, (op, i, j) in enumerate(edit_script(one, two)):
                    rows.append((pair, seq, op, i + (op != "+"), j + (op != "-"), new[j] if op == "+" else old[i]))
            yield pd.DataFrame(rows, columns=["pair_id", "seq", "op", "old_line", "new_line", "text"])

    return pairs.select("pair_id", "old", "new").mapInPandas(run, "pair_id long, seq long, op string, old_line long, new_line long, text string")


def unified_diffs(scripts: DataFrame, old_name: Column, new_name: Column) -> DataFrame:
    """pair_id, diff: a unified diff without context of each pair that differs; names are of pair_id."""
    pair = W.partitionBy("pair_id").orderBy("seq")
    changed = scripts.withColumn("_hunk", F.count_if(F.col("op") == "=").over(pair.rowsBetween(W.unboundedPreceding, 0))).where("op <> '='")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("op") == "+").alias("added"), "seq", "op", "text"))), lambda x: F.concat(x["op"], x["text"])), "\n")
    number = lambda c, op: F.when(F.count_if(F.col("op") == op) > 0, F.min(F.when(F.col("op") == op, F.col(c)))).otherwise(F.min(c))
    hunks = changed.groupBy("pair_id", "_hunk").agg(
        number("old_line", "-").alias("_a"), number("new_line", "+").alias("_b"), F.count_if(F.col("op") == "-").alias("_n"), F.count_if(F.col("op") == "+").alias("_m"), lines.alias("_lines")
    )
    length = lambda n: F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string")))
    head = F.concat(F.lit("@@ -"), F.col("_a").cast("string"), length("_n"), F.lit(" +"), F.col("_b").cast("string"), length("_m"), F.lit(" @@\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_hunk", F.concat(head, F.col("_lines")).alias("text")))), lambda x: x["text"]), "\n")
    return hunks.groupBy("pair_id").agg(body.alias("diff")).select("pair_id", F.concat(F.lit("--- a/"), old_name, F.lit("\n+++ b/"), new_name, F.lit("\n"), "diff").alias("diff"))


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """file, op (+, -), line, text of the changed lines of unified diffs (a column diff, and pair_id that tells them apart).

    `+++ b/` names the file of what follows, `@@` the lines where it goes on; what a hunk says of its lengths tells its lines
    from names, so that a deleted line `-- x` is none. Removed lines have the number of the old file.
    """
    lines = diffs.select("pair_id", F.posexplode(F.split("diff", "\n")).alias("p", "l"))
    up_to = W.partitionBy("pair_id").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    field = lambda k: F.regexp_extract("l", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    count = lambda k: F.when(field(k) == "", 1).otherwise(field(k).cast("long"))
    # A line that looks like a header inside a hunk is one of its lines: a hunk's header says how many follow.
    starts = lines.withColumn("_h", F.when(field(1) != "", F.struct(F.col("p").alias("at"), field(1).cast("long").alias("old"), count(2).alias("n"), field(3).cast("long").alias("new"), count(4).alias("m"))))
    spans = starts.withColumn("h", F.last("_h", True).over(up_to))
    inside = F.col("h").isNotNull() & (F.col("p") > F.col("h.at")) & (F.col("p") <= F.col("h.at") + F.col("h.n") + F.col("h.m"))
    named = spans.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("file", F.last(F.when(~F.col("_in") & F.col("l").startswith("+++ b/"), F.substr("l", F.lit(7))), True).over(up_to))
    step = F.col("p") - F.col("h.at") - 1
    removed = F.col("l").startswith("-")
    line = F.when(removed, F.col("h.old") + step).otherwise(F.col("h.new") + step - F.col("h.n"))
    return named.where("_in").select("pair_id", "file", F.when(removed, "-").otherwise("+").alias("op"), line.alias("line"), F.substr("l", F.lit(2)).alias("text"))


def numstat(scripts: DataFrame) -> DataFrame:
    """pair_id, added, deleted."""
    return scripts.groupBy("pair_id").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("deleted"))


def gate(changes: DataFrame, by: str, max_lines: int = MAX_LINES, max_files: int = MAX_FILES, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """What the gate says of changes (file, added, deleted, and what they are grouped by).

    Returns lines and files that count, exempted, too_many_lines, too_many_files, passed, and top: the five largest as
    `lines file`, ties by name. The largest are kept while they are added up, so no group is gathered.
    """
    counted = ~F.col("file").rlike("|".join(map(X.glob_regex, exempt))) if exempt else F.lit(True)
    changed = F.col("added") + F.col("deleted")
    rows = changes.withColumn("_c", counted).withColumn("_n", F.when(F.col("_c"), changed).otherwise(0))
    # Five of each group by task first, then five of those.
    rank = F.row_number().over(W.partitionBy(by, "_part").orderBy(F.desc("_n"), "file"))
    some = rows.where("_c").withColumn("_part", F.pmod(F.xxhash64("file"), F.lit(64))).withColumn("_r", rank).where("_r <= 5")
    top = some.groupBy(F.col(by).alias("_by")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("less"), "file"))), 1, 5).alias("_top"))
    totals = rows.groupBy(by).agg(F.sum("_n").alias("lines"), F.count_if("_c").alias("files"), F.count_if(~F.col("_c")).alias("exempted"))
    out = totals.join(top, F.col(by).eqNullSafe(F.col("_by")), "left")
    shown = F.array_join(F.transform("_top", lambda x: F.concat((-x["less"]).cast("string"), F.lit(" "), x["file"])), "; ")
    more, many = F.col("lines") > max_lines, F.col("files") > max_files
    return out.select(by, "lines", "files", "exempted", more.alias("too_many_lines"), many.alias("too_many_files"), (~more & ~many).alias("passed"), F.coalesce(shown, F.lit("")).alias("top"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id (doc_id), first, source, old, new: lines of each document and of the first (by doc_id) that begins with the same line."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text", F.substring_index("text", "\n", 1).alias("head"))
    heads = docs.where("trim(head) <> ''").groupBy(F.sha2("head", 256).alias("_head")).agg(F.min("doc_id").alias("first"))
    pairs = cut(docs.select("doc_id", "source", F.sha2("head", 256).alias("_head")).join(heads, "_head").where("doc_id > first").drop("_head"))
    split = lambda name: F.split("text", "\n").alias(name)
    new = pairs.join(docs.select("doc_id", split("new")), "doc_id")
    return new.join(docs.select(F.col("doc_id").alias("first"), split("old")), "first").select(F.col("doc_id").alias("pair_id"), "first", "source", "old", "new")


# DuckDB: the longest common subsequence of each pair, row by row; a row is the running maximum of what it may go on from.
_PAIRS_SQL = """_d AS (SELECT doc_id, source, text, split_part(text, chr(10), 1) AS head FROM documents WHERE text IS NOT NULL),
_f AS (SELECT head, min(doc_id) AS first FROM _d WHERE trim(head) <> '' GROUP BY head),
_p AS (SELECT n.doc_id, first, n.source, string_split(o.text, chr(10)) AS a, string_split(n.text, chr(10)) AS b FROM _d n JOIN _f ON _f.head = n.head AND n.doc_id > first JOIN _d o ON o.doc_id = first),
_l AS (SELECT doc_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM _p
 UNION ALL SELECT doc_id, i, list_transform(range(1, len(v) + 1), lambda k: list_max(v[1:k])) FROM (
  SELECT _l.doc_id, _l.i + 1 AS i, list_transform(range(1, len(row) + 1), lambda k: CASE WHEN k > 1 AND a[_l.i + 1] = b[k - 1] THEN row[k - 1] + 1 ELSE row[k] END) AS v FROM _l JOIN _p ON _p.doc_id = _l.doc_id WHERE _l.i < len(a))),
_n AS (SELECT _p.doc_id, first, source, len(b) - row[-1] AS added, len(a) - row[-1] AS deleted FROM _p JOIN _l ON _l.doc_id = _p.doc_id AND _l.i = len(a))"""


@query("WITH RECURSIVE " + _PAIRS_SQL + " SELECT doc_id, first, added, deleted FROM _n")
def edit_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each copy adds and leaves out."""
    pairs = cut(copies(spark, sf_dir))
    return numstat(edit_scripts(pairs)).join(pairs.select("pair_id", "first"), "pair_id").select(F.col("pair_id").alias("doc_id"), "first", "added", "deleted")


@query(
    "WITH RECURSIVE "
    + _PAIRS_SQL
    + f""", _c AS (SELECT source, concat(source, '/', CASE WHEN doc_id % 7 = 0 THEN 'license/' ELSE '' END, doc_id) AS file, added + deleted AS n FROM _n),
_x AS (SELECT *, NOT (file GLOB '{EXEMPT[0]}' OR file GLOB '{EXEMPT[1]}') AS counts FROM _c),
_t AS (SELECT source, string_agg(n || ' ' || file, '; ' ORDER BY n DESC, file) AS top FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, file) AS r FROM _x WHERE counts) WHERE r <= 5 GROUP BY source)
SELECT s.source, lines, files, exempted, lines > {MAX_LINES} AS too_many_lines, files > {MAX_FILES} AS too_many_files, lines <= {MAX_LINES} AND files <= {MAX_FILES} AS passed, coalesce(top, '') AS top
FROM (SELECT source, CAST(coalesce(sum(n) FILTER (WHERE counts), 0) AS BIGINT) AS lines, count(*) FILTER (WHERE counts) AS files, count(*) FILTER (WHERE NOT counts) AS exempted FROM _x GROUP BY source) s LEFT JOIN _t ON _t.source IS NOT DISTINCT FROM s.source"""
)
def edit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on the copies of each source, a file each, of which some lie in an exempted folder."""
    pairs = cut(copies(spark, sf_dir))
    folder = F.when(F.col("pair_id") % 7 == 0, "license/").otherwise("")
    files = pairs.select("pair_id", "source", F.concat("source", F.lit("/"), folder, F.col("pair_id").cast("string")).alias("file"))
    return gate(numstat(edit_scripts(pairs)).join(files, "pair_id"), "source")


@query()
def edit_added_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a copy adds and that hold a secret or a risk, read from unified diffs. tests/test_diffs.py holds each part."""
    pair = F.col("pair_id").cast("string")
    added = parse_diffs(unified_diffs(edit_scripts(copies(spark, sf_dir)), pair, pair)).where("op = '+'")
    hit = lambda patterns: F.array_contains(F.array(*[F.rlike("text", F.lit(p)) for p in patterns]), True)
    kind = F.when(hit(SECRET_BLOCK + SECRET_BLOCK_MORE), "block").when(hit(SECRET_WARN + SECRET_WARN_MORE), "warn")
    return added.select("file", "line", kind.alias("kind")).where("kind is not null")
