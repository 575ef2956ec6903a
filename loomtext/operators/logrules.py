"""The rules of the event log's JSON lines: records, files, what may be appended, and failures that come back.

A log is a table (file, line, raw): a file is one loop's, its lines are numbered from 1 as they lie in it. Lines are parsed
into variants and never collected; what a rule needs of a file is aggregated by file, or joined by (file, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.plans.registry import query
from loomtext.sources.scratch import cut
from loomtext.sources.tables import LOG_LINES_SQL, NEW_LINES_SQL, log_lines, new_log_lines

# The envelope, the fields that each event's data has to have, with their JSON types, and the values allowed.
ENVELOPE = ("v", "ts", "project", "loop_id", "event", "data")
EVENT_FIELDS = {
    "loop_start": {"goal": "string", "spec_refs": "array", "scaffold_version": "string", "agent": "string"},
    "stage_end": {"stage": "integer", "stage_name": "string", "result": "string"},
    "test_run": {"command": "string", "passed": "integer", "failed": "integer"},
    "failure": {"code": "string", "severity": "string", "detected_stage": "integer", "summary": "string", "resolution": "string"},
    "escalation": {"reason": "string", "question": "string"},
    "commit": {"sha": "string", "kind": "string"},
    "loop_end": {"outcome": "string", "failure_count": "integer", "summary": "string"},
    "correction": {"supersedes": "integer", "reason": "string"},
}
ENUMS = {
    ("stage_end", "result"): ("pass", "fail", "skip"),
    ("loop_end", "outcome"): ("success", "partial", "aborted"),
    ("commit", "kind"): ("feat", "fix", "test", "docs", "refactor", "chore", "data", "spec"),
}
SEVERITIES = ("S1", "S2", "S3")
RESOLUTIONS = ("retry", "rollback", "escalate", "harness_fix", "spec_fix", "test_fix", "accepted")
CODES = (
    "SPEC-AMB", "SPEC-GAP", "SPEC-DRIFT", "CTX-ROT", "CTX-MISS", "CTX-STALE", "GEN-HALLUC", "GEN-LOGIC", "GEN-CHARS", "GEN-LAYOUT", "GEN-SCOPE", "GEN-REGRESS",
    "VERIF-GAP", "VERIF-FLAKE", "VERIF-FALSE", "TOOL-ENV", "TOOL-MISUSE", "TOOL-PERM", "PROC-SKIP", "PROC-BUDGET", "PROC-LOOP", "DATA-SRC", "DATA-QUAL",
)
#: From this version on a project that is the loop's own name is an error; before, a warning.
STRICT_FROM = (1, 2)

_FIELDS = sorted({f for fields in EVENT_FIELDS.values() for f in fields})


def _kind(path: str) -> Column:
    """The JSON type of a path: null where it is missing."""
    shown = F.schema_of_variant(F.try_variant_get("json", path, "variant"))
    return (
        F.when(shown.isNull(), None)
        .when(shown == "STRING", "string")
        .when(shown.startswith("ARRAY"), "array")
        .when(shown.startswith("OBJECT"), "object")
        # A truth value passes for a number, as it does where the log is written.
        .when(shown.isin("BIGINT", "BOOLEAN"), "integer")
        .otherwise("other")
    )


def version(v: Column) -> Column:
    """"1.2" as [1, 2], for comparisons; [0] for what is no version."""
    parts = F.transform(F.split(v, r"\."), lambda x: F.when(x.rlike(r"^[0-9]+$"), x.cast("int")))
    return F.when(v.isNotNull() & F.forall(parts, lambda x: x.isNotNull()), parts).otherwise(F.array(F.lit(0)))


def parse(lines: DataFrame) -> DataFrame:
    """file, line, json, the envelope's texts and the types of it and of data's fields. Blank lines are left out."""
    found = lines.where(F.trim("raw") != "").withColumn("json", F.try_parse_json("raw"))
    found = found.withColumn("json", F.when(F.schema_of_variant("json").startswith("OBJECT"), F.col("json")))
    text = lambda path: F.try_variant_get("json", path, "string")
    return found.select(
        "file", "line", "json",
        *[_kind(f"$.{f}").alias(f"kind_{f}") for f in ENVELOPE],
        *[text(f"$.{f}").alias(f) for f in ENVELOPE[:-1]],
        *[_kind(f"$.data.{f}").alias(f"kind_data_{f}") for f in _FIELDS],
        *[text(f"$.data.{f}").alias(f"data_{f}") for f in _FIELDS],
        text("$.data.harness_ref").alias("data_harness_ref"),
    )


def _supersedes() -> Column:
    return F.when((F.col("event") == "correction") & (F.col("kind_data_supersedes") == "integer"), F.coalesce(F.expr("try_cast(data_supersedes AS BIGINT)"), (F.col("data_supersedes") == "true").cast("long")))


def record_rules(parsed: DataFrame) -> DataFrame:
    """file, line, rule: each rule that a record breaks by itself."""
    missing = [F.when(F.col(f"kind_{f}").isNull(), f"no {f}") for f in ENVELOPE]
    whole = F.col("json").isNotNull()
    for f in ENVELOPE:
        whole &= F.col(f"kind_{f}").isNotNull()
    known = whole & F.col("event").isin(*EVENT_FIELDS) & (F.col("kind_event") == "string")
    rules = [F.when(F.col("json").isNull(), "no JSON object"), *[F.when(F.col("json").isNotNull(), m) for m in missing]]
    rules.append(F.when(whole & ~(F.col("event").isin(*EVENT_FIELDS) & (F.col("kind_event") == "string")), "unknown event"))
    rules.append(F.when(known & (F.col("kind_data") != "object"), "data is no object"))
    known &= F.col("kind_data") == "object"
    for event, fields in EVENT_FIELDS.items():
        own = known & (F.col("event") == event)
        for f, kind in fields.items():
            rules.append(F.when(own & F.col(f"kind_data_{f}").isNull(), f"no data.{f}"))
            rules.append(F.when(own & F.col(f"kind_data_{f}").isNotNull() & (F.col(f"kind_data_{f}") != kind), f"type of data.{f}"))
    for (event, f), allowed in ENUMS.items():
        rules.append(F.when(known & (F.col("event") == event) & F.col(f"kind_data_{f}").isNotNull() & ~((F.col(f"kind_data_{f}") == "string") & F.col(f"data_{f}").isin(*allowed)), f"value of data.{f}"))
    for f, allowed in (("code", CODES), ("severity", SEVERITIES), ("resolution", RESOLUTIONS)):
        rules.append(F.when(known & (F.col("event") == "failure") & F.col(f"data_{f}").isNotNull() & ~F.col(f"data_{f}").isin(*allowed), f"value of data.{f}"))
    rules.append(F.when(known & (F.col("event") == "failure") & (F.col("data_resolution") == "harness_fix") & (F.coalesce("data_harness_ref", F.lit("")) == ""), "harness_fix without harness_ref"))
    return parsed.select("file", "line", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def corrections(parsed: DataFrame) -> DataFrame:
    """file, line, target and the rule that each correction breaks; null where it voids its target (the first one does)."""
    wrong = parsed.where((F.col("event") == "correction") & F.col("json").isNotNull()).select("file", "line", _supersedes().alias("target"))
    targets = parsed.where("json IS NOT NULL").select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("event").alias("_event"))
    joined = wrong.join(targets, (F.col("file") == F.col("_file")) & (F.col("target") == F.col("_line")), "left")
    earlier = F.coalesce(F.col("_line") < F.col("line"), F.lit(False))
    usable = earlier & ~F.coalesce(F.col("_event") == "correction", F.lit(False))
    nth = F.sum(usable.cast("int")).over(W.partitionBy("file", "target").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rule = F.when(~earlier, "target is no earlier line").when(~usable, "target is a correction").when(nth > 1, "target is void already")
    return joined.select("file", "line", "target", F.col("_event").alias("target_event"), rule.alias("rule"))


def effective(parsed: DataFrame) -> DataFrame:
    """The parsed records that are no corrections and that none voids."""
    void = corrections(parsed).where("rule IS NULL").select(F.col("file").alias("_file"), F.col("target").alias("_line"))
    rows = parsed.where("json IS NOT NULL AND NOT event <=> 'correction'")
    return rows.join(void, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")), "left_anti")


def repair_budget(parsed: DataFrame) -> DataFrame:
    """file, event, n: records that some correction names as its target, one for each correction."""
    named = corrections(parsed).where("target_event IS NOT NULL")
    return named.groupBy("file", F.col("target_event").alias("event")).agg(F.count(F.lit(1)).alias("n"))


def file_rules(parsed: DataFrame) -> DataFrame:
    """file, line (null for the file as a whole), rule, severity ('error' or 'warning')."""
    # Parsing is the dearest part, and what is read below is little of it: it is written once, as are the effective records.
    used = ("v", "ts", "project", "loop_id", "event", "kind_project", "kind_data_supersedes", "data_supersedes", "data_failure_count")
    parsed = cut(parsed.select("file", "line", F.when(F.col("json").isNotNull(), True).alias("json"), *used))
    good, own = parsed.where("json IS NOT NULL"), cut(effective(parsed))
    error = lambda df, rule: df.select("file", "line", F.lit(rule).alias("rule"), F.lit("error").alias("severity"))
    whole = lambda df, rule, severity="error": df.select("file", F.lit(None).cast("long").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    strict = version(F.col("v")) >= F.array(*map(F.lit, STRICT_FROM))
    polluted = own.where("kind_project = 'string' AND project = loop_id")
    projects = own.where("kind_project = 'string'").groupBy("file").agg(F.min("project").alias("a"), F.max("project").alias("b"), F.max(strict.cast("int")).alias("strict")).where("a <> b")
    order = W.partitionBy("file").orderBy("line")
    disorder = good.select("file", "ts", F.lag("ts").over(order).alias("_before")).where("coalesce(ts, '') < coalesce(_before, '')").select("file").distinct()
    files = parsed.groupBy("file").agg(F.count("json").alias("n"))
    facts = own.groupBy("file").agg(
        F.min(F.struct("line", "event")).alias("first"),
        F.count(F.when(F.col("event") == "loop_end", 1)).alias("ends"),
        F.min(F.when(F.col("event") == "loop_end", F.struct("line", F.expr("try_cast(data_failure_count AS BIGINT)").alias("declared")))).alias("end"),
        F.count(F.when(F.col("event") == "failure", 1)).alias("failures"),
    )
    end = facts.where("end IS NOT NULL").select(F.col("file").alias("_file"), F.col("end.line").alias("_end"))
    after = own.join(end, (F.col("file") == F.col("_file")) & (F.col("line") > F.col("_end"))).groupBy("file", "event").agg(F.count(F.lit(1)).alias("used"))
    budget = repair_budget(parsed).select(F.col("file").alias("_bf"), F.col("event").alias("_be"), F.col("n").alias("_n"))
    beyond = after.join(budget, (F.col("file") == F.col("_bf")) & F.col("event").eqNullSafe(F.col("_be")), "left").where("used > coalesce(_n, 0)").select("file").distinct()
    parts = [
        error(good.where("loop_id <> '' AND loop_id <> file"), "loop_id is not the file's"),
        corrections(parsed).where("rule IS NOT NULL").select("file", "line", "rule", F.lit("error").alias("severity")),
        error(polluted.where(strict), "project is the loop"),
        whole(polluted.where(~strict).select("file").distinct(), "project is the loop in old records", "warning"),
        whole(projects.where("strict = 1"), "several projects"),
        whole(projects.where("strict = 0"), "several projects", "warning"),
        whole(disorder, "ts out of order"),
        whole(files.where("n = 0"), "no records"),
        whole(files.where("n > 0").join(facts.select(F.col("file").alias("_file")), F.col("file") == F.col("_file"), "left_anti"), "no effective records"),
        whole(facts.where("NOT first.event <=> 'loop_start'"), "first is no loop_start"),
        whole(facts.where("ends > 1"), "several loop_end"),
        whole(beyond, "records behind loop_end"),
        whole(facts.where("end.declared <> failures"), "failure_count is wrong"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def append_guard(log: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each record (file, raw) of new, were it appended to its file by itself: file, raw, refused, warning.

    refused: why it isn't taken, or null. warning: 'S1 without harness_ref', or 'second' and 'again without harness_ref' for
    a failure code that effective records of any file have already; null for others. new has no two equal rows.
    """
    parsed, own = parse(log), effective(parse(log))
    keyed = new.withColumn("_id", F.xxhash64("file", "raw"))
    fresh = parse(keyed.select(F.col("_id").alias("file"), F.lit(0).cast("long").alias("line"), "raw")).drop("line").withColumnRenamed("file", "_id")
    broken = record_rules(fresh.withColumn("file", F.col("_id")).withColumn("line", F.lit(0).cast("long"))).select(F.col("file").alias("_bad")).distinct()
    state = own.groupBy("file").agg(
        F.min(F.when(F.col("kind_project") == "string", F.struct("line", "project"))).alias("first"), F.count(F.lit(1)).alias("n"), F.max((F.col("event") == "loop_end").cast("int")).alias("ended")
    )
    ends = parsed.where("event = 'loop_end'").groupBy("file").agg(F.max("line").alias("_end")).withColumnRenamed("file", "_ef")
    used = parsed.join(ends, (F.col("file") == F.col("_ef")) & (F.col("line") > F.col("_end"))).groupBy(F.col("file").alias("_uf"), F.col("event").alias("_ue")).agg(F.count(F.lit(1)).alias("used"))
    budget = repair_budget(parsed).select(F.col("file").alias("_bf"), F.col("event").alias("_be"), F.col("n").alias("slots"))
    prior = own.where("event = 'failure'").groupBy(F.col("data_code").alias("_code")).agg(F.count(F.lit(1)).alias("prior"))
    lines = own.select(F.col("file").alias("_tf"), F.col("line").alias("_tl"), F.col("event").alias("target_event"))
    x = keyed.join(fresh.select("_id", "event", "project", "data_code", "data_severity", "data_harness_ref", _supersedes().alias("target")).withColumnRenamed("_id", "_fid"), F.col("_id") == F.col("_fid"), "left")
    x = x.join(broken, F.col("_id") == F.col("_bad"), "left").join(state.withColumnRenamed("file", "_sf"), F.col("file") == F.col("_sf"), "left")
    x = x.join(lines, (F.col("file") == F.col("_tf")) & (F.col("target") == F.col("_tl")), "left")
    x = x.join(budget, (F.col("file") == F.col("_bf")) & (F.col("event") == F.col("_be")), "left").join(used, (F.col("file") == F.col("_uf")) & (F.col("event") == F.col("_ue")), "left")
    x = x.join(prior, F.col("data_code") == F.col("_code"), "left")
    correction, total = F.col("event") == "correction", F.coalesce("prior", F.lit(0)) + 1
    refused = (
        F.when(F.col("_bad").isNotNull() | F.col("_fid").isNull(), "record")
        # The file's project is that of its first effective record whose project is a text.
        .when(~correction & F.col("first").isNotNull() & ~F.col("project").eqNullSafe(F.col("first.project")), "project")
        .when(correction & F.col("target_event").isNull(), "target")
        .when(correction & (F.col("target_event") == "loop_start") & (F.col("n") > 1), "loop_start")
        .when(~correction & (F.coalesce("ended", F.lit(0)) == 1) & ~(F.coalesce("used", F.lit(0)) < F.coalesce("slots", F.lit(0))), "closed")
    )
    unreferenced = F.coalesce("data_harness_ref", F.lit("")) == ""
    warning = F.when(F.col("event") == "failure", F.when((F.col("data_severity") == "S1") & unreferenced, "S1 without harness_ref").when(total == 2, "second").when((total > 2) & unreferenced, "again without harness_ref"))
    return x.select("file", "raw", refused.alias("refused"), F.when(refused.isNull(), warning).alias("warning"))


def strikes(log: DataFrame) -> DataFrame:
    """code, n, files, needs, referenced: effective failures of each code in all files; two or more need a reference."""
    own = effective(parse(log)).where("event = 'failure'")
    return own.groupBy(F.col("data_code").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), (F.count(F.lit(1)) >= 2).alias("needs"), F.max(F.coalesce("data_harness_ref", F.lit("")) != "").alias("referenced")
    )


def running_strikes(log: DataFrame) -> DataFrame:
    """file, line, code, n: the effective failures whose code has come up before, in this file or one before it by name.

    What comes before a file is summed over one row for each file and code; only a file's own failures are ordered.
    """
    own = effective(parse(log)).where("event = 'failure'").select("file", "line", F.col("data_code").alias("code"))
    by_file = own.groupBy("code", "file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("code").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = by_file.select(F.col("code").alias("_code"), F.col("file").alias("_file"), earlier.alias("_before"))
    ranked = own.withColumn("_k", F.row_number().over(W.partitionBy("file", "code").orderBy("line")))
    found = ranked.join(before, F.col("code").eqNullSafe(F.col("_code")) & (F.col("file") == F.col("_file")))
    return found.select("file", "line", "code", (F.col("_before") + F.col("_k")).alias("n")).where("n >= 2")


def flatten(log: DataFrame) -> DataFrame:
    """file, line, the envelope's texts, field, value: each field of data as a row, objects and arrays as JSON."""
    rows = parse(log).where("json IS NOT NULL").select("file", "line", "v", "ts", "project", "loop_id", "event", F.try_variant_get("json", "$.data", "map<string, variant>").alias("_d"))
    return rows.select("file", "line", "event", F.explode("_d").alias("field", "_v")).select("file", "line", "event", F.concat(F.lit("data_"), "field").alias("field"), F.col("_v").cast("string").alias("value"))


# The DuckDB twins, written apart from the rules above: JSON functions in place of variants.
_PARSED = (
    LOG_LINES_SQL
    + """,
_j AS (SELECT file, line, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN raw END AS j FROM log_lines WHERE trim(raw) <> ''),
_r AS (SELECT file, line, j, j ->> '$.event' AS event, j ->> '$.project' AS project, j ->> '$.loop_id' AS loop_id, j ->> '$.ts' AS ts, j ->> '$.v' AS v,
  CASE WHEN j ->> '$.event' = 'correction' AND json_type(j, '$.data.supersedes') IN ('BIGINT', 'UBIGINT') THEN CAST(j ->> '$.data.supersedes' AS BIGINT) END AS target FROM _j),
_c AS (SELECT c.file, c.line, c.target, t.event AS te, t.line IS NOT NULL AND t.line < c.line AS earlier,
  t.line IS NOT NULL AND t.line < c.line AND coalesce(t.event, '') <> 'correction' AS usable
  FROM _r c LEFT JOIN _r t ON t.file = c.file AND t.line = c.target AND t.j IS NOT NULL WHERE c.event = 'correction' AND c.j IS NOT NULL),
_k AS (SELECT *, count(CASE WHEN usable THEN 1 END) OVER (PARTITION BY file, target ORDER BY line ROWS UNBOUNDED PRECEDING) AS nth FROM _c),
_e AS (SELECT * FROM _r WHERE j IS NOT NULL AND event IS DISTINCT FROM 'correction' AND NOT EXISTS (SELECT 1 FROM _k WHERE _k.file = _r.file AND _k.target = _r.line AND usable AND nth = 1))"""
)


def _record_sql(table: str) -> str:
    kind = lambda path: f"CASE json_type(j, '{path}') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'integer' ELSE 'other' END"
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    parts = [f"SELECT file, line, 'no JSON object' AS rule FROM {table} WHERE j IS NULL"]
    parts += [f"SELECT file, line, 'no {f}' FROM {table} WHERE j IS NOT NULL AND NOT json_exists(j, '$.{f}')" for f in ENVELOPE]
    whole = "j IS NOT NULL AND " + " AND ".join(f"json_exists(j, '$.{f}')" for f in ENVELOPE)
    parts.append(f"SELECT file, line, 'unknown event' FROM {table} WHERE {whole} AND coalesce(event, '') NOT IN ({listed(EVENT_FIELDS)})")
    known = f"{whole} AND event IN ({listed(EVENT_FIELDS)})"
    parts.append(f"SELECT file, line, 'data is no object' FROM {table} WHERE {known} AND json_type(j, '$.data') <> 'OBJECT'")
    known += " AND json_type(j, '$.data') = 'OBJECT'"
    for event, fields in EVENT_FIELDS.items():
        for f, want in fields.items():
            own = f"{known} AND event = '{event}'"
            parts.append(f"SELECT file, line, 'no data.{f}' FROM {table} WHERE {own} AND NOT json_exists(j, '$.data.{f}')")
            parts.append(f"SELECT file, line, 'type of data.{f}' FROM {table} WHERE {own} AND json_exists(j, '$.data.{f}') AND {kind('$.data.' + f)} <> '{want}'")
    for (event, f), allowed in ENUMS.items():
        parts.append(f"SELECT file, line, 'value of data.{f}' FROM {table} WHERE {known} AND event = '{event}' AND json_exists(j, '$.data.{f}') AND (json_type(j, '$.data.{f}') <> 'VARCHAR' OR j ->> '$.data.{f}' NOT IN ({listed(allowed)}))")
    for f, allowed in (("code", CODES), ("severity", SEVERITIES), ("resolution", RESOLUTIONS)):
        parts.append(f"SELECT file, line, 'value of data.{f}' FROM {table} WHERE {known} AND event = 'failure' AND j ->> '$.data.{f}' NOT IN ({listed(allowed)})")
    parts.append(f"SELECT file, line, 'harness_fix without harness_ref' FROM {table} WHERE {known} AND event = 'failure' AND j ->> '$.data.resolution' = 'harness_fix' AND coalesce(j ->> '$.data.harness_ref', '') = ''")
    return " UNION ALL ".join(parts)


_FILE_SQL = (
    "WITH "
    + _PARSED
    + """,
_s AS (SELECT *, regexp_full_match(coalesce(v, ''), '[0-9]+([.][0-9]+)*') AND list_transform(string_split(v, '.'), lambda x: TRY_CAST(x AS INT)) >= [1, 2] AS strict FROM _e WHERE json_type(j, '$.project') = 'VARCHAR'),
_end AS (SELECT file, min(line) AS at FROM _e WHERE event = 'loop_end' GROUP BY file),
_after AS (SELECT _e.file, _e.event, count(*) AS used FROM _e JOIN _end ON _end.file = _e.file AND _e.line > _end.at GROUP BY ALL),
_budget AS (SELECT file, te AS event, count(*) AS n FROM _k WHERE te IS NOT NULL GROUP BY ALL)
SELECT file, line, 'loop_id is not the file''s' AS rule, 'error' AS severity FROM _r WHERE j IS NOT NULL AND loop_id <> '' AND loop_id <> file
UNION ALL SELECT file, line, CASE WHEN NOT earlier THEN 'target is no earlier line' WHEN NOT usable THEN 'target is a correction' ELSE 'target is void already' END, 'error' FROM _k WHERE NOT (usable AND nth = 1)
UNION ALL SELECT file, line, 'project is the loop', 'error' FROM _s WHERE project = loop_id AND strict
UNION ALL SELECT DISTINCT file, CAST(NULL AS BIGINT), 'project is the loop in old records', 'warning' FROM _s WHERE project = loop_id AND NOT strict
UNION ALL SELECT file, NULL, 'several projects', CASE WHEN bool_or(strict) THEN 'error' ELSE 'warning' END FROM _s GROUP BY file HAVING count(DISTINCT project) > 1
UNION ALL SELECT file, NULL, 'ts out of order', 'error' FROM (SELECT file, list(coalesce(ts, '') ORDER BY line) AS t FROM _r WHERE j IS NOT NULL GROUP BY file) WHERE t <> list_sort(t)
UNION ALL SELECT file, NULL, 'no records', 'error' FROM _r GROUP BY file HAVING count(j) = 0
UNION ALL SELECT file, NULL, 'no effective records', 'error' FROM _r GROUP BY file HAVING count(j) > 0 AND file NOT IN (SELECT file FROM _e)
UNION ALL SELECT file, NULL, 'first is no loop_start', 'error' FROM (SELECT file, event, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM _e) WHERE k = 1 AND event IS DISTINCT FROM 'loop_start'
UNION ALL SELECT file, NULL, 'several loop_end', 'error' FROM _e WHERE event = 'loop_end' GROUP BY file HAVING count(*) > 1
UNION ALL SELECT DISTINCT a.file, NULL, 'records behind loop_end', 'error' FROM _after a LEFT JOIN _budget b ON b.file = a.file AND b.event IS NOT DISTINCT FROM a.event WHERE a.used > coalesce(b.n, 0)
UNION ALL SELECT e.file, NULL, 'failure_count is wrong', 'error' FROM _e e JOIN _end ON _end.file = e.file AND _end.at = e.line WHERE TRY_CAST(e.j ->> '$.data.failure_count' AS BIGINT) <> (SELECT count(*) FROM _e f WHERE f.file = e.file AND f.event = 'failure')"""
)
#: DuckDB: records to be appended, with why they are refused, as _y.
GUARD_CTES = (
    "WITH "
    + _PARSED
    + ","
    + NEW_LINES_SQL
    + """,
_n AS (SELECT file, 0 AS line, raw, j, j ->> '$.event' AS event FROM (SELECT file, raw, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN raw END AS j FROM new_lines)),
_w AS (SELECT _n.raw, _n.file AS wf FROM _n JOIN ("""
    + _record_sql("(SELECT raw AS file, 0 AS line, j, event FROM _n)")
    + """) b ON b.file = _n.raw GROUP BY ALL),
_first AS (SELECT file, arg_min(CASE WHEN json_type(j, '$.project') = 'VARCHAR' THEN project END, line) AS project, count(*) AS n, bool_or(coalesce(event = 'loop_end', false)) AS ended FROM _e GROUP BY file),
_last AS (SELECT file, max(line) AS at FROM _r WHERE event = 'loop_end' GROUP BY file),
_x AS (SELECT n.*, w.raw IS NOT NULL AS broken, f.project AS fp, f.n AS fn, f.ended, t.event AS te,
  (SELECT count(*) FROM _k WHERE _k.file = n.file AND _k.te = n.event) AS slots,
  (SELECT count(*) FROM _r JOIN _last l ON l.file = _r.file AND _r.line > l.at WHERE _r.file = n.file AND _r.event = n.event) AS used,
  (SELECT count(*) FROM _e WHERE event = 'failure' AND _e.j ->> '$.data.code' = n.j ->> '$.data.code') + 1 AS total
  FROM _n n LEFT JOIN _w w ON w.raw = n.raw AND w.wf = n.file LEFT JOIN _first f ON f.file = n.file
  LEFT JOIN _e t ON t.file = n.file AND n.event = 'correction' AND t.line = TRY_CAST(n.j ->> '$.data.supersedes' AS BIGINT)),
_y AS (SELECT *, CASE WHEN broken THEN 'record' WHEN event <> 'correction' AND fp <> j ->> '$.project' THEN 'project' WHEN event = 'correction' AND te IS NULL THEN 'target'
  WHEN event = 'correction' AND te = 'loop_start' AND fn > 1 THEN 'loop_start' WHEN event <> 'correction' AND ended AND NOT used < slots THEN 'closed' END AS refused FROM _x)"""
)
_GUARD_SQL = (
    GUARD_CTES
    + """ SELECT file, raw, refused, CASE WHEN refused IS NULL AND event = 'failure' THEN CASE WHEN j ->> '$.data.severity' = 'S1' AND coalesce(j ->> '$.data.harness_ref', '') = '' THEN 'S1 without harness_ref'
  WHEN total = 2 THEN 'second' WHEN total > 2 AND coalesce(j ->> '$.data.harness_ref', '') = '' THEN 'again without harness_ref' END END AS warning FROM _y"""
)


@query("WITH " + _PARSED + " " + _record_sql("_r"))
def log_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rules(parse(log_lines(spark, sf_dir)))


@query(_FILE_SQL)
def log_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_rules(parse(log_lines(spark, sf_dir)))


@query(_GUARD_SQL)
def log_append_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_guard(log_lines(spark, sf_dir), new_log_lines(spark, sf_dir))


@query("WITH " + _PARSED + " SELECT j ->> '$.data.code' AS code, count(*) AS n, count(DISTINCT file) AS files, count(*) >= 2 AS needs, bool_or(coalesce(j ->> '$.data.harness_ref', '') <> '') AS referenced FROM _e WHERE event = 'failure' GROUP BY 1")
def log_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strikes(log_lines(spark, sf_dir))


@query("WITH " + _PARSED + " SELECT file, line, code, n FROM (SELECT file, line, j ->> '$.data.code' AS code, count(*) OVER (PARTITION BY j ->> '$.data.code' ORDER BY file, line) AS n FROM _e WHERE event = 'failure') WHERE n >= 2")
def two_strike_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_strikes(log_lines(spark, sf_dir))


@query(
    "WITH " + _PARSED + ", _d AS (SELECT file, line, event, j -> '$.data' AS d FROM _r WHERE j IS NOT NULL AND json_type(j, '$.data') = 'OBJECT'), "
    "_f AS (SELECT file, line, event, unnest(json_keys(d)) AS f, d FROM _d) SELECT file, line, event, 'data_' || f AS field, CASE WHEN json_type(d, f) = 'NULL' THEN NULL ELSE d ->> f END AS value FROM _f"
)
def log_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(log_lines(spark, sf_dir))
