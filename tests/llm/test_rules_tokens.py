"""op8 reads the whole sequence of tokens."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import queries, rules


def grams_of(text):
    tokens = [t for w in text.split() for t in re.findall(r"[^\W_]+|[\W_]+", w)]
    return [tokens, list(zip(tokens, tokens[1:], strict=False))]


def test_log_ratio_of_tokens_and_pairs(spark):
    rows = [(1, "good words, here (often)"), (2, "good words there; ünd 3 more"), (3, "bad### x###"), (4, ""), (5, "one")]
    every, good = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        for k, g in enumerate(grams_of(t)):
            every[k].update(g)
            good[k].update(g * (i in (1, 2)))
    buckets = 1 << 20  # no two n-grams meet
    share = lambda c, g: (c[g] + 1) / (sum(c.values()) + buckets)
    want = {i: [np.log(share(good[k], g) / share(every[k], g)) for k, gs in enumerate(grams_of(t)) for g in gs] for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["llr"] for r in rules.judge(df, spark.createDataFrame([(1,), (2,)], "doc_id long"), buckets=buckets).collect()}
    assert got == pytest.approx({i: float(np.mean(x)) if x else 0.0 for i, x in want.items()})


def test_query_sees_insides_of_words_and_order(spark, tmp_path):
    """Wrong words with ordinary beginnings and endings, and shuffled texts, score below the prose they come from."""
    rng = random.Random(1)
    words = [f"be{chr(97 + k % 26)}middle{k:03d}ing" for k in range(60)]
    prose = [" ".join(words[k % 60] for k in range(s, s + 80)) for s in range(40)]
    shuffled = [" ".join(rng.sample(t.split(), 80)) for t in prose]
    wrong = [re.sub(r"middle\d+", lambda m: f"wrung{rng.randrange(1000)}", t) for t in prose]
    rows = list(enumerate(prose + shuffled + wrong))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    llr = {r["doc_id"]: r["llr"] for r in queries.op8_ngram_ratio_rules(spark, str(tmp_path)).collect()}
    least = min(llr[i] for i in range(40))
    assert all(llr[i] < least - 0.1 for i in range(40, 120))


def test_kept_on_labelled_documents(spark):
    """The threshold comes from held trusted documents alone; it keeps good documents and rejects most bad ones."""
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op8_ngram_ratio_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    kept = {y: [rows[i]["kept"] for i, q in truth.items() if q == y and not rows[i]["base_failed"]] for y in (0, 1)}
    print({y: (len(x), float(np.mean(x))) for y, x in kept.items()})
    assert np.mean(kept[1]) > 0.95
    passed = [r["llr"] for r in rows.values() if r["kept"]]
    assert all(r["kept"] or r["base_failed"] or r["llr"] < min(passed) for r in rows.values())


def test_threshold_is_a_quantile(spark):
    scored = spark.createDataFrame([(i, i == 7, i / 100) for i in range(100)], "doc_id long, base_failed boolean, llr double")
    held = spark.range(0, 100, 2).selectExpr("id AS doc_id")
    least = lambda lost: rules.quantile_threshold(scored, held, lost).first()["threshold"]
    assert least(0.0) == pytest.approx(0.0, abs=2e-3) and least(0.1) == pytest.approx(0.1, abs=2e-3)
    assert rules.quantile_threshold(scored, held.limit(0)).first()["threshold"] is None
