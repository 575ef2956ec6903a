"""Terms, scripts and sections of texts; exact tests by folding distributions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import misc, scripts, sections, spans, stats


@pytest.mark.parametrize("seed", range(40))
def test_longest_terms_win(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "b", "ba", "a b", "b a", "ab a", "b ab a"]
    terms, masks = rng.sample(words, rng.randint(1, 6)), rng.sample(["aa", "bb"], rng.randint(0, 2))
    text = " ".join("".join(rng.choice("abAB") for _ in range(rng.randint(1, 3))) for _ in range(12))
    rest, want = text, []
    for mask in masks:
        rest = re.sub(rf"(?i)\b{mask}\w*", lambda m: "\x01" * len(m.group()), rest)
    for term in sorted(terms, key=lambda t: -len(t)):  # one pass for each term, as the sweep does in one
        want += [(term, m.start(), m.end()) for m in re.finditer(rf"(?i)\b{term}\w*", rest)]
        rest = re.sub(rf"(?i)\b{term}\w*", lambda m: "\x01" * len(m.group()), rest)
    assert spans.longest_spans(text, spans.term_automaton(terms, masks)) == sorted(want, key=lambda s: s[1])


def test_spans_of_odd_texts(spark):
    rows = spark.createDataFrame([("x", "Zwei İzwei zweimal, ZWEI"), ("y", None), ("z", ""), ("w", "zwei" * 30_000)], "id string, text string")
    got = sorted((r["id"], r["start"], len(r["word"])) for r in spans.term_spans(rows, ["zwei", ""]).collect())
    assert got == [("w", 0, 120_000), ("x", 0, 4), ("x", 11, 7), ("x", 20, 4)]
    assert spans.term_spans(rows, []).count() == 0


def test_runs_of_scripts(spark):
    texts = [(1, "… Hello, мир! 42 漢字かな end"), (2, None), (3, ""), (4, "123"), (5, "naïve café Ωmega"), (6, "ⴰⴱ x"), (7, "pаypal аpple ok 漢字かな カタab")]  # 7 has Cyrillic а
    df = spark.createDataFrame(texts, "id int, text string")
    got: dict[int, list] = {}
    for r in scripts.script_runs(df).orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append((r["script"], r["text"]))
    assert got[1] == [("Latin", "Hello, "), ("Cyrillic", "мир! 42 "), ("Han", "漢字"), ("Hiragana", "かな "), ("Latin", "end")]
    assert got[5] == [("Latin", "naïve café "), ("Greek", "Ω"), ("Latin", "mega")] and got[6] == [("Other", "ⴰⴱ "), ("Latin", "x")]
    assert got.keys() == {1, 5, 6, 7}
    assert [(r["id"], r["nth"], r["scripts"]) for r in scripts.mixed_words(df).orderBy("id", "nth").collect()] == [(5, 3, "Latin+Greek"), (7, 1, "Latin+Cyrillic"), (7, 2, "Latin+Cyrillic"), (7, 5, "Latin+Katakana")]
    signs = spark.createDataFrame([(1, "a\rb\r\nc\x07\t\n\x0b"), (2, None), (3, "end\r")], "id int, text string")
    assert [tuple(r) for r in scripts.stray_signs(signs).orderBy("id").collect()] == [(1, 2, 1), (2, 0, 0), (3, 0, 1)]


def test_japanese_sentences(spark):
    texts = ["むりだ！　つぎの文。", "「行くぞ！」と言った。彼は笑った。", "本当か？いや。終わり", "「はい」「いいえ」など。次"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.sentences_ja(F.col("t"))).collect()]
    assert got == [["むりだ！", "つぎの文。"], ["「行くぞ！」と言った。", "彼は笑った。"], ["本当か？", "いや。", "終わり"], ["「はい」", "「いいえ」など。", "次"]]


def test_attention_is_folded(spark):
    """Layers averaged, summed over a source's tokens, averaged over a target's, then over windows."""
    rows = [(w, y, t, s, t // 2 + w, s // 3 + w, ((3 * t + 5 * s + 7 * w + y) % 11) / 11) for w in range(3) for y in range(2) for t in range(4) for s in range(6)]
    x = np.array([r[6] for r in rows]).reshape(3, 2, 4, 6).mean(1).reshape(3, 4, 2, 3).sum(3).reshape(3, 2, 2, 2).mean(2)
    want: dict[tuple, list] = {}
    for w, d, o in itertools.product(range(3), range(2), range(2)):
        want.setdefault((d + w, o + w), []).append(x[w, d, o])
    got = {(r["dst"], r["src"]): r["score"] for r in misc.fold_attention(spark.createDataFrame(rows, "w int, layer int, t int, s int, dst int, src int, x double")).collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()}, abs=1e-6)


def test_tree_of_a_page(spark):
    html = """<html><head><title>no</title><style>p{}</style></head><body>before<nav><ul><li>one<li>two</ul></nav><h1>Top &amp; <b>more</b></h1><p>a<br>b<p>c<script>var t='<p>no</p>';</script>
    <h3>Deep</h3>x<h2>Second</h2><div>y<h2></h2><p> </p><!-- <p>no --><h1>Last</h1><p>end"""
    assert sections.walk(html) == [
        ("paragraph", 0, 0, None, "before"), ("paragraph", 0, 0, None, "one"), ("paragraph", 0, 0, None, "two"), ("heading", 1, 1, 0, "Top & more"), ("paragraph", 0, 1, None, "a b"), ("paragraph", 0, 1, None, "c"),
        ("heading", 3, 2, 1, "Deep"), ("paragraph", 0, 2, None, "x"), ("heading", 2, 3, 1, "Second"), ("paragraph", 0, 3, None, "y"), ("heading", 2, 4, 1, ""), ("heading", 1, 5, 0, "Last"), ("paragraph", 0, 5, None, "end"),
    ]
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain & text"), (5, "<p>" * 20_000 + "x")], "page_id long, html string")
    tree = sections.page_tree(pages)
    assert [tuple(r) for r in tree.where("page_id > 1").orderBy("page_id").collect()] == [(4, 0, "paragraph", 0, 0, None, "plain & text"), (5, 0, "paragraph", 0, 0, None, "x")]
    assert [tuple(r) for r in sections.section_paths(tree).orderBy("section").collect()] == [
        (1, 1, "1", "Top & more", 2, 4), (1, 2, "1.1", "Deep", 1, 1), (1, 3, "1.2", "Second", 1, 1), (1, 4, "1.3", "", 0, 0), (1, 5, "2", "Last", 1, 3)
    ]


def enumerated(diffs, sizes):
    total = sum(sizes)
    observed = sum(diffs) / total
    sums = [sum(s * d for s, d in zip(signs, diffs, strict=True)) / total for signs in itertools.product((1, -1), repeat=len(diffs))]
    return observed, sum(abs(x) >= abs(observed) - 1e-12 for x in sums) / len(sums)


@pytest.mark.parametrize("seed", range(6))
def test_exact_test_is_that_of_all_signs(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    diffs, sizes = [rng.randint(-6, 6) * 0.5 for _ in range(n)], [rng.randint(1, 4) for _ in range(n)]
    got = stats.exact(spark.createDataFrame(list(zip(diffs, sizes, strict=True)), "diff double, size int"), 0.5).first()
    assert (got["observed"], got["p_value"], got["blocks"]) == (pytest.approx(enumerated(diffs, sizes)[0]), pytest.approx(enumerated(diffs, sizes)[1]), n)


def test_exact_test_of_many_blocks_and_of_none(spark, monkeypatch):
    values, chances = stats.signed_sums({1: 1_000_000, 3: 40_000})
    assert chances.sum() == pytest.approx(1, abs=1e-9) and (chances * values**2).sum() == pytest.approx(1_000_000 + 9 * 40_000, rel=1e-6)
    small = stats.signed_sums({1: 30, 2: 11, 5: 4})
    monkeypatch.setattr(stats, "DIRECT", 0)
    assert np.abs(stats.signed_sums({1: 30, 2: 11, 5: 4})[1] - small[1]).max() < 1e-14
    none = spark.createDataFrame([], "diff double, size int")
    assert stats.exact(none).count() == 0 and stats.exact(spark.createDataFrame([(0.0, 0)], "diff double, size int")).count() == 0
    assert stats.exact(spark.createDataFrame([(0.0, 2), (None, 1)], "diff double, size int")).first()["p_value"] == 1
    with pytest.raises(Exception, match="no multiple"):
        stats.exact(spark.createDataFrame([(0.3, 2)], "diff double, size int")).collect()


def test_references_in_headings(spark, monkeypatch):
    """With signs_only, other references and those without their end stay as they are written; small batches lose nothing."""
    html = "<h1>a &lt;b&gt; &amp;lt; &quot;c&quot; &amp</h1><p>d</p>"
    assert [r[-1] for r in sections.walk(html, signs_only=True)] == ["a <b> &lt; &quot;c&quot; &amp", "d"]
    monkeypatch.setattr(sections, "YIELDED", 1)
    pages = spark.createDataFrame([(k, html) for k in range(9)] + [(9, None), (10, "")], "page_id long, html string")
    found = sections.page_tree(pages, signs_only=True).orderBy("page_id", "ord").collect()
    assert [(r["page_id"], r["ord"], r["text"]) for r in found] == [(k, n, t) for k in range(9) for n, t in enumerate(["a <b> &lt; &quot;c&quot; &amp", "d"])]
