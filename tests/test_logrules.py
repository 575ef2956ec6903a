"""The event log's rules on small logs, case by case."""

import json

from pyspark.sql import functions as F

from loomtext.operators import logrules as L

START = {"goal": "g", "spec_refs": [], "scaffold_version": "1", "agent": "a"}
END = {"outcome": "success", "failure_count": 0, "summary": "s"}
FAIL = {"code": "GEN-LOGIC", "severity": "S2", "detected_stage": 1, "summary": "s", "resolution": "retry"}


def rec(event, data, file="LOOP", **more):
    return json.dumps({"v": "1.2", "ts": "2026-01-01", "project": "main", "loop_id": file, "event": event, "data": data} | more, ensure_ascii=False)


def undo(line):
    return rec("correction", {"supersedes": line, "reason": "r"})


def log(spark, files):
    """files: for each its lines, in which LOOP stands for its name."""
    rows = [(f"loop_{n}", k + 1, raw.replace("LOOP", f"loop_{n}")) for n, raws in enumerate(files) for k, raw in enumerate(raws)]
    return spark.createDataFrame(rows, "file string, line long, raw string")


RECORDS = [
    (rec("loop_start", START), []), ("{broken", ["no JSON object"]), ("[]", ["no JSON object"]), (json.dumps({"v": 1}), sorted(f"no {f}" for f in L.ENVELOPE[1:])),
    (rec("party", {}), ["unknown event"]), (rec("commit", "x"), ["data is no object"]), (rec("commit", {"sha": 1, "kind": "fix"}), ["type of data.sha"]), (rec("commit", {"sha": "a", "kind": "odd"}), ["value of data.kind"]),
    (rec("test_run", {"command": "c", "passed": 1.5, "failed": None}), ["type of data.failed", "type of data.passed"]), (rec("test_run", {"command": "c", "passed": True, "failed": 0}), []),
    (rec("failure", FAIL | {"code": "NONE", "severity": "S9", "resolution": "hope"}), ["value of data.code", "value of data.resolution", "value of data.severity"]),
    (rec("failure", FAIL | {"resolution": "harness_fix"}), ["harness_fix without harness_ref"]), (rec("failure", FAIL | {"resolution": "harness_fix", "harness_ref": "HC-1"}), []),
]


def test_record_rules(spark):
    found = {}
    for r in L.record_rules(L.parse(log(spark, [[raw] for raw, _ in RECORDS]))).collect():
        found.setdefault(r["file"], []).append(r["rule"])
    assert [sorted(found.get(f"loop_{k}", [])) for k in range(len(RECORDS))] == [rules for _, rules in RECORDS]


def test_rules_of_a_file(spark):
    start, end, fail = rec("loop_start", START), rec("loop_end", END), rec("failure", FAIL)
    closed, old = rec("loop_end", END | {"failure_count": 1}), rec("loop_start", START, v="1.1", project="LOOP")
    late = "project is the loop in old records"
    cases = [
        ([start, "", end], []),
        ([fail], ["first is no loop_start"]),
        (["{broken"], ["no records"]),
        ([start, undo(1)], ["no effective records"]),
        ([start, end, end], ["several loop_end", "records behind loop_end"]),
        ([start, fail, end], ["failure_count is wrong"]),
        ([start, end, fail], ["records behind loop_end", "failure_count is wrong"]),
        # A slot that a correction opened takes one record of the same event behind the end.
        ([start, fail, closed, undo(2), fail], []),
        ([start, fail, closed, undo(2), fail, fail], ["records behind loop_end", "failure_count is wrong"]),
        ([start, undo(2), undo(9), undo(1), undo(1)], ["target is no earlier line", "target is no earlier line", "target is void already", "no effective records"]),
        ([start, fail, undo(2), undo(3)], ["target is a correction"]),
        ([start, rec("failure", FAIL, loop_id="other")], ["loop_id is not the file's"]),
        ([start, rec("failure", FAIL, ts="2025-12-31")], ["ts out of order"]),
        ([start, rec("failure", FAIL, project="LOOP")], ["project is the loop", "several projects"]),
        ([old], [(late, "warning")]),
        ([old, rec("failure", FAIL, v="1.1")], [(late, "warning"), ("several projects", "warning")]),
    ]
    found = {}
    for r in L.file_rules(L.parse(log(spark, [raws for raws, _ in cases]))).collect():
        found.setdefault(r["file"], []).append((r["rule"], r["severity"]))
    want = [sorted((r, "error") if isinstance(r, str) else r for r in rules) for _, rules in cases]
    assert [sorted(found.get(f"loop_{k}", [])) for k in range(len(cases))] == want


def test_what_may_be_appended(spark):
    start, fail = rec("loop_start", START), rec("failure", FAIL)
    closed = [start, fail, rec("loop_end", END | {"failure_count": 1})]
    cases = [
        ([start], rec("commit", {"sha": "a"}), ("record", None)),
        ([start], "{broken", ("record", None)),
        ([start], rec("commit", {"sha": "a", "kind": "fix"}, project="other"), ("project", None)),
        ([start], undo(1), (None, None)),
        ([start, fail], undo(1), ("loop_start", None)),
        ([start, fail], undo(7), ("target", None)),
        ([start, fail, undo(2)], undo(2), ("target", None)),
        (closed, fail, ("closed", None)),
        ([*closed, undo(2)], fail, (None, None)),
        ([*closed, undo(2), fail], fail, ("closed", None)),
        ([start], fail, (None, None)),
        ([start, fail], fail, (None, "second")),
        ([start, fail, fail], fail, (None, "again without harness_ref")),
        ([start, fail, fail], rec("failure", FAIL | {"harness_ref": "HC-1"}), (None, None)),
        ([start], rec("failure", FAIL | {"severity": "S1"}), (None, "S1 without harness_ref")),
        ([], start, (None, None)),
    ]
    # Each case has a failure code of its own, as strikes are counted over all files.
    own = lambda raw, k: raw.replace("GEN-LOGIC", L.CODES[k])
    new = spark.createDataFrame([(f"loop_{k}", own(raw, k).replace("LOOP", f"loop_{k}")) for k, (_, raw, _) in enumerate(cases)], "file string, raw string")
    found = {r["file"]: (r["refused"], r["warning"]) for r in L.append_guard(log(spark, [[own(r, k) for r in raws] for k, (raws, _, _) in enumerate(cases)]), new).collect()}
    assert [found[f"loop_{k}"] for k in range(len(cases))] == [want for _, _, want in cases]


def test_strikes_count_effective_failures_of_all_files(spark):
    fail = rec("failure", FAIL)
    both = log(spark, [[rec("loop_start", START), fail, fail, undo(2)], [rec("loop_start", START), fail]])
    assert [tuple(r) for r in L.strikes(both).collect()] == [("GEN-LOGIC", 2, 2, True, False)]
    assert [tuple(r) for r in L.running_strikes(both).collect()] == [("loop_1", 2, "GEN-LOGIC", 2)]


def test_versions(spark):
    rows = spark.createDataFrame([("1.2",), ("1.10",), ("x",), (None,), ("2",)], "v string").select(L.version(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [[1, 2], [1, 10], [0], [0], [2]]


def test_project_of_a_file_is_its_first_text(spark):
    """A first record whose project is a number names none; the next one's holds."""
    made = {"sha": "a", "kind": "fix"}
    old = [[rec("loop_start", START, project=7), rec("commit", made)]]
    new = spark.createDataFrame([("loop_0", rec("commit", made, "loop_0", project=p)) for p in ("main", "other")], "file string, raw string")
    found = {json.loads(r["raw"])["project"]: r["refused"] for r in L.append_guard(log(spark, old), new).collect()}
    assert found == {"main": None, "other": "project"}


def test_lines_are_parsed_once_for_the_rules_of_files(spark):
    """The plan of all rules holds no parsing: what they read was written."""
    found = L.file_rules(L.parse(log(spark, [[rec("loop_start", START), undo(1), "{broken"]])))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "variant" not in plan.lower()
    assert found.count() > 0
