"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

import corpus_pipeline
from loomtext.llm import toxicity

from .test_dedup import brute_components, brute_removed
from .test_tokens import assert_packed


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        read[name] = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {n: [(r["doc_id"], r["text"]) for r in d.orderBy("doc_id").collect()] for n, d in read.items()}
    scores = toxicity.score_toxicity(read["toxicity"], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert [i for i, _ in rows["near_dedup"]] == sorted(r["doc_id"] for r in scores if r["predicted"] == 0)
    assert [i for i, _ in rows["substring_dedup"]] == sorted(set(brute_components(rows["near_dedup"], 5).values()))
    want = brute_removed(rows["substring_dedup"], 20)
    left = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in rows["mixing"]}
    assert left == {i: n - gone for i, (n, gone, _) in want.items()}
    assert_packed(docs.collect(), rows["packing"])
