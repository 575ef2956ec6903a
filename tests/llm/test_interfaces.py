"""General interfaces of the operators: schedules, folding, evidence, spans, sums, and the stages' edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import language, mixing, quality, tokens, toxicity
from loomtext.llm.common import DOCUMENT_COLUMNS

from .conftest import edge_rows, prose

STEPS = ((0.0, 2.0), (0.25, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, STEPS])
def test_time_inverts_the_integral(spark, schedule):
    times, weights = zip(*schedule, strict=True)
    grid = np.linspace(0, 1, 100_001)
    # np.interp takes the later knot of a step from its time on.
    w = np.interp(grid, np.array(times) + np.arange(len(times)) * 1e-12, weights)
    share = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    share /= share[-1]
    rows = spark.createDataFrame([(float(s),) for s in np.linspace(0, 1, 41)], "s double").withColumn("t", mixing.time_of(F.col("s"), schedule)).collect()
    for r in rows:
        assert 0 <= r["t"] <= 1 and np.interp(r["t"], grid, share) == pytest.approx(r["s"], abs=1e-3)
    assert [r["t"] for r in rows] == sorted(r["t"] for r in rows)


@pytest.mark.parametrize("schedule", [((0.0, 1.0),), ((0.0, 1.0), (0.9, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, -1.0), (1.0, 2.0))])
def test_schedules_are_checked(schedule):
    with pytest.raises(ValueError, match="schedule"):
        mixing.demand(schedule)


def test_curriculum_takes_what_the_mix_counts(spark):
    rows = [(1, "a b c", "x", "p"), (1, "a b c", "x", "p"), (1, "a b c", "x", "q"), (2, "d e", "y", "p"), (3, "f " * 500, "z", "p"), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    counted = Counter()
    for r in mixing.mix(df).collect():
        counted[r["doc_id"], r["source"]] += r["copies"]
    taken = [tuple(r) for r in mixing.curriculum(df, ["doc_id", "source", "lang"]).collect()]
    assert Counter(t[:2] for t in taken) == Counter({k: n for k, n in counted.items() if n})
    assert {t for t in taken if t[0] == 1} == {(1, "x", "p"), (1, "x", "q")}


def test_order_follows_the_schedules(spark):
    rows = [(k, prose(k, 40), s) for k, s in enumerate("abc" * 60)]
    order = [r["source"] for r in mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"]).collect()]
    half = len(order) // 2
    early, late = Counter(order[:half]), Counter(order[half:])
    assert early["a"] > late["a"] and early["c"] < late["c"]


@pytest.mark.parametrize("text", ["a$$hole", "@sshole", "assho1e", "4$$h0le", "a s s h o l e", "ass-hole"[:3] + "hole"])
def test_signs_digits_and_spelling(text):
    m = toxicity.Matcher(toxicity.Lexicon({"asshole": 2.0}))
    assert toxicity.density(m, f"what an {text} he is".encode()) > 0


def test_plain_texts_fold_to_themselves():
    for text in ("in 1984 the 3 wars", "a b c", "costs $5, mail me@x.org now!", "l1 and 10th"):
        words = toxicity.fold(text).split()
        assert "1984" not in text or "1984" in words
        assert len(words) >= 2


def test_phrases_and_exceptions_are_learned(spark):
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        body = prose(k, 60) + (" go home zorg " if toxic and k % 8 else " ") + (" snarl " if toxic and not k % 8 else "") + (" snarl fish " if k % 4 == 1 else "")
        rows.append((k, body + prose(1000 + k, 30)))
        labels.append((k, float(toxic)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label double"))
    assert "zorg" in lexicon.weights
    assert not any(" " in w and (set(w.split()) & set(lexicon.weights)) for w in lexicon.weights)
    assert "snarl" not in lexicon.weights or "snarl fish" in lexicon.exceptions


def test_calibration_and_lexicon_read_different_rows(spark):
    from pyspark.sql import functions as F

    ids = spark.range(1000).select(F.col("id").alias("doc_id"))
    assert 150 < ids.where(toxicity._calibrates()).count() < 350


@pytest.mark.parametrize(("url", "parts"), [
    ("http://www.example.com/x", ("www.example.com", "example.com", "com")), ("https://user@Shop.Example.co.uk:80/", ("shop.example.co.uk", "example.co.uk", "uk")),
    ("//example.de", ("example.de", "example.de", "de")), ("http://a.b.c.example.com.au/", ("a.b.c.example.com.au", "example.com.au", "au")), (None, ("", "", "")), ("nonsense", ("", "", "")),
])
def test_hosts_and_registered_domains(url, parts):
    assert language.host_parts(url) == parts


def test_posterior_against_brute_force(spark):
    docs = spark.createDataFrame([("the and of it was with " * 30, "en"), ("der die das und nicht mit " * 30, "de"), ("le la les et dans une " * 30, "fr")], "text string, lang string")
    texts = ["the and of it", "der die das und", "le la les et", "", "the die la"]
    rows = [(k, [f"http://{'ab'[k % 2]}.site.com/{k}", f"http://x{k % 3}.other.de/", None][k % 3], f'<html lang="{["en", "de", "fr"][k % 3]}"><p>{texts[k % 5]} {texts[(k // 2) % 5]}</p>' if k % 4 else texts[k % 5]) for k in range(45)]
    found = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    counts = language.language_counts(docs)
    langs, shares = list(counts), language.log_shares(counts)
    pages = []
    for _, url, html in rows:
        text = language.visible_text((html or "").encode())
        x = language.TEMPER * np.array([sum(shares[i][b] for b in language.run_buckets(text)) for i in range(3)])
        ll = np.maximum(x - x.max(), -language.MOST_NATS)
        pages.append((ll, np.exp(ll) / np.exp(ll).sum(), *language.host_parts(url), language.declared_language((html or "").encode()) or ""))
    for k, (ll, post, host, domain, suffix, declared) in enumerate(pages):
        rest = [p for i, p in enumerate(pages) if i != k]
        total = lambda keep: sum((p[1] for p in rest if keep(p)), np.zeros(3))  # noqa: B023, E731
        every = total(lambda p: True)
        world = (every + language.GLOBAL_WEIGHT) / (every.sum() + 3 * language.GLOBAL_WEIGHT)
        others = total(lambda p: host and p[3] == domain and p[2] != host)  # noqa: B023
        own = total(lambda p: host and p[2] == host)  # noqa: B023
        by_domain = (others + language.DOMAIN_WEIGHT * world) / (others.sum() + language.DOMAIN_WEIGHT)
        prior = (own + language.HOST_WEIGHT * by_domain) / (own.sum() + language.HOST_WEIGHT)
        p = np.exp(ll) * prior * (total(lambda q: q[4] == suffix) + world) / (every + 1) * (total(lambda q: q[5] == declared) + world) / (every + 1)  # noqa: B023
        p /= p.sum()
        assert found[k]["lang"] == langs[int(p.argmax())] or p.max() - np.sort(p)[-2] < 1e-9
        assert found[k]["probability"] == pytest.approx(p.max(), rel=1e-6)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_crossing_tokens_by_each_rule(rule):
    starts, ends = np.array([0, 2, 7]), np.array([2, 7, 9])
    s0, s1 = np.array([0, 3, 5]), np.array([3, 5, 9])  # the second token has 1, 2 and 2 bytes in the three
    counts, crossing = tokens.attribute(starts, ends, s0, s1, rule)
    assert counts.tolist() == pytest.approx({"first": [2, 0, 1], "last": [1, 0, 2], "most": [1, 1, 1], "share": [1.2, 0.4, 1.4]}[rule])
    assert crossing.tolist() == [1, 1, 1]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_fields_share_out_the_tokens_of_the_whole(spark, rule):
    rows = [(1, "A title", "Some text, ß 漢字."), (2, None, "x"), (3, "only", None), (4, None, None), (None, "t", "u")]
    found = tokens.field_tokens(spark.createDataFrame(rows, "doc_id long, title string, text string"), ["title", "text"], rule=rule).collect()
    encoder = tokens.ByteEncoder(tokens.tokenizer_path())
    for i, title, text in rows:
        own = sorted((r["section"], r["n_bytes"], r["n_tokens"], r["doc_tokens"]) for r in found if r["doc_id"] == i)
        whole = f"{title or ''}\n{text or ''}".encode()
        starts, _ = encoder.spans(whole)
        cut = len((title or "").encode()) + 1
        assert [o[1] for o in own] == [cut, len(whole) - cut] and own[0][3] == len(starts)
        assert sum(o[2] for o in own) == pytest.approx(len(starts))
        if rule == "first":
            assert own[0][2] == sum(s < cut for s in starts)


def test_normal_equations_and_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, quality.N_STATISTICS))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    df = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "doc_id long, stats array<double>, label double").repartition(7)
    model = quality.fit(df, features=64)
    fold = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0).select("doc_id").collect()}
    own = np.array(sorted(fold))
    z = model.fourier(x[own])
    penalty = np.eye(65) * quality.RIDGE * len(own) / 64
    penalty[-1, -1] = 1e-9
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y[own]), rel=1e-5, abs=1e-7)
    assert model.mean == pytest.approx(x[own].mean(0))
    # Products of features approximate the Gaussian kernel of the scaled statistics.
    many = quality.fit(df, features=4000)
    s = np.clip((x[:20] - many.mean) / many.scale, -6, 6)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / 2 / quality.BANDWIDTH**2)
    approx = many.fourier(x[:20])[:, :-1]
    assert np.abs(approx @ approx.T - kernel).max() < 0.1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_cases_of_each_stage(spark, edge, nothing, tmp_path, name):
    """Nulls, repeats, empty and long texts and clashing columns; toxic labels exist for a few of the rows."""
    spark.createDataFrame([(0, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, str(tmp_path)).count() == 0
    out = stage(spark, edge, str(tmp_path))
    rows = out.collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in rows) == len(edge_rows())
        return
    assert out.columns == list(DOCUMENT_COLUMNS)
    ids = {r[0] for r in edge_rows()}
    if name == "near_dedup":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(ids - {None} - {1, 2})
    elif name == "mixing":
        assert {r["doc_id"] for r in rows} <= ids
    else:
        assert len(rows) == len(edge_rows())


def test_pipeline_runs_as_a_whole(spark, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bins = Counter()
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and math.isfinite(sum(bins.values()))
    assert {r["doc_id"] for r in rows} <= {r[0] for r in edge_rows()} - {1, 2}
