"""Classifiers by held-out accuracy, language fusion, rules, fingerprints."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import fingerprint, language, quality, queries, rules, toxicity
from loomtext.llm.calibrate import isotonic

from .conftest import edge_rows


@pytest.mark.parametrize(("name", "label"), [("op1_quality_classifier", "quality"), ("op5_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(rows[i]["predicted"], y) for i, y in truth.items() if i in rows and rows[i]["held_out"]]
    majority = max(Counter(y for _, y in held).values()) / len(held)
    assert np.mean([p == y for p, y in held]) >= max(0.9, majority)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edge_cases_of_classifiers(spark, edge, nothing, score):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (2, 1, 1), (None, 1, 1), (4, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    found = score(edge, labels).collect()
    assert len(found) == len(edge_rows())
    assert all(r["score"] is not None and r["held_out"] is not None for r in found)
    assert score(nothing, labels).count() == 0
    assert {r["score"] for r in score(edge, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark, small):
    df, _ = small
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    rows = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in quality.score_quality(df, x).collect())
    assert rows(labels) == rows(flipped)


def test_isotonic_rises():
    x, y = isotonic([(0, 10, 5), (1, 10, 1), (2, 10, 9), (5, 10, 10)], 0.0, 1.0, 10)
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def test_folding_and_exceptions():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 2.0, "clown": 1.0}))
    for text in ("You IDIOT!", "1d10t", "іdіоt", "id1ot,"):
        assert m.weight(toxicity.fold(text))[0] == 2.0, text
    assert m.weight(toxicity.fold("a clown fish"))[0] == 0
    assert m.weight(toxicity.fold("idiotic 2024"))[0] == 0
    assert m.weight(toxicity.fold("idiot idiot"))[0] == 4.0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_rules_against_brute_force(spark, small, edge, nothing):
    df, rows = small
    trusted = rules.trusted_by_label(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = {r["doc_id"]: r for r in rules.judge(df, trusted, threshold=-0.4).collect()}
    assert {i: tuple(found[i][c] for c in columns) for i in found} == {i: brute_counts(t) for i, t in rows}
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= -0.4) for r in found.values())
    counted = sorted(tuple(r[c] for c in columns) for r in rules.judge(edge, trusted).collect())
    assert counted == sorted(brute_counts(r[1] or "") for r in edge_rows())
    assert rules.judge(nothing, trusted).count() == 0
    assert rules.judge(edge, trusted.limit(0)).count() == len(edge_rows())


def test_fingerprints(small, edge, nothing):
    df, rows = small
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = Counter(text.split()), Counter(other.split())
            errors.append(near - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, found[i]["fingerprint"]) == found[i]["fingerprint"]
    odd = fingerprint.fingerprints(edge).collect()
    assert len(odd) == len(edge_rows())
    assert {r["fingerprint"] for r in odd if r["doc_id"] in (3, 4, 5)} == {"0" * 4 * fingerprint.SAMPLES}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in odd)
    assert fingerprint.fingerprints(nothing).count() == 0


def test_languages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    found = language.identify(pages, docs).collect()
    assert np.mean([r["text_lang"] == r["declared"] for r in found]) > 0.95
    assert np.mean([r["lang"] == r["declared"] for r in found]) > 0.95
    odd = spark.createDataFrame([(1, None, None, 1), (1, "http://x.de/", "", 1), (None, "nonsense", "<p>the and of", 2), (2, "//h.fr", '<html lang="fr">' + "x" * 99_999, 3)], "page_id long, url string, html string, host int")
    assert len(language.identify(odd, docs).collect()) == 4
    assert language.identify(odd.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify(odd, docs.limit(0)).collect()} == {None}


def test_language_evidence_is_fused(spark):
    """A page whose text says nothing takes its host's language, and a wrong declaration gives way to a long text."""
    docs = spark.createDataFrame([("the and of it was with " * 30, "en"), ("der die das und nicht mit " * 30, "de")], "text string, lang string")
    rows = [(k, f"http://a.example.de/{k}", '<html lang="de"><p>der die das und nicht mit') for k in range(20)]
    rows += [(k, f"http://b.example.com/{k}", '<html lang="en"><p>the and of it was with') for k in range(20, 40)]
    rows += [(50, "http://a.example.de/x", ""), (51, "http://b.example.com/x", ""), (52, "http://b.example.com/y", '<html lang="de"><p>' + "the and of it was with " * 40)]
    found = {r["page_id"]: r["lang"] for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (found[50], found[51], found[52]) == ("de", "en", "en")
