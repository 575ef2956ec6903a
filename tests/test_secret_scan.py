"""secret_scan against Python's re, with the reference's patterns."""

import re

from loomtext.plans import catalog

BLOCK = [
    r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*['\"][^'\"]{8,}['\"]",
    r"token = .[0-9a-f]+",
]
WARN = [r"\beval\s*\(", r"(?i)(execute|cursor\.execute)\s*\(\s*[\"'].*%s.*[\"']\s*%", r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"]
CASES = [
    ("-----BEGIN RSA PRIVATE KEY-----", "block"), ("-----BEGIN PRIVATE KEY-----", "block"), ("-----BEGIN PUBLIC KEY-----", None), ("x\nAKIA" + "A1" * 8 + "\ny", "block"), ("AKIA123", None),
    ("API-KEY: 'abcdefgh'", "block"), ("password=\"longenough\"", "block"), ("password='short'", None), ("mypassword = 'longenough'", None), ("token = 'ff", "block"),
    ("eval (x)", "warn"), ("medieval(x)", None), ("äeval(x)", None), ("cursor.EXECUTE('select %s' % x)", "warn"), ("execute('select %s'\n% x)", None), ("eval(x)\nsecret: 'abcdefgh'", "block"),
    ("secret:\n'abcdefgh'", None), ("at 10.0.0.1", "warn"), ("plain", None), ("", None), (None, None),
]


def brute(text):
    lines = (text or "").split("\n")
    hit = lambda patterns: any(re.search(p, x) for p in patterns for x in lines)
    return "block" if hit(BLOCK) else "warn" if hit(WARN) else None


def test_each_pattern(spark, tmp_path):
    assert [brute(t) for t, _ in CASES] == [k for _, k in CASES]
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kind"] for r in catalog.QUERIES["secret_scan"](spark, str(tmp_path)).collect()}
    assert got == {i: k for i, (_, k) in enumerate(CASES) if k}


def test_whole_table(spark, sf_dir):
    want = {r["doc_id"]: brute(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["kind"] for r in catalog.QUERIES["secret_scan"](spark, sf_dir).collect()} == {i: k for i, k in want.items() if k}
