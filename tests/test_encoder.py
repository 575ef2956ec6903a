"""bert_forward_tiny reads whole texts."""

import numpy as np

from loomtext.plans import catalog


def test_every_piece_counts(spark, tmp_path):
    a, b = ("first piece " * 11)[:128], ("and another " * 11)[:128]
    texts = [a, b, a + b, a + "tail", "tail", a[:64] + "x" * 64, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: np.array(r["pooled"]) for r in catalog.QUERIES["bert_forward_tiny"](spark, str(tmp_path)).collect()}
    assert np.allclose(got[2], (got[0] + got[1]) / 2)
    assert np.allclose(got[3], (128 * got[0] + 4 * got[4]) / 132)
    assert not np.allclose(got[0], got[5])
    assert np.allclose(got[6], got[7]) and np.isfinite(got[6]).all()
