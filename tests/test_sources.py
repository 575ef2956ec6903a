"""Readers and writers: charsets, safetensors, vectors, JSON and CSV, each read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import align, misc, ranks, segment, vectors
from loomtext.sources import formats, scratch, sinks


def test_legacy_charset(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("むりだ。\n次".encode("shift_jis"))
    (tmp_path / "b.txt").write_bytes(b"plain")
    found = {r["path"].rpartition("/")[2]: r["text"] for r in formats.read_charset(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "むりだ。\n次", "b.txt": "plain"}
    (tmp_path / "c.txt").write_bytes(b"\x81")
    with pytest.raises(Exception, match="decode"):
        formats.read_charset(spark, str(tmp_path)).collect()


def test_safetensors_round_trip_and_faults():
    tensors = {"w": np.arange(6, dtype="<f4").reshape(2, 3), "b": np.arange(4, dtype="<i8"), "s": np.array(2.5, "<f8")}
    content = formats.write_safetensors(tensors)
    found = {n: np.frombuffer(raw, formats._DTYPES[d]).reshape(shape) for n, d, shape, raw in formats.parse_safetensors(content)}
    assert all((found[n] == x).all() for n, x in tensors.items()) and found.keys() == tensors.keys()

    def made(header, body=b""):
        text = json.dumps(header).encode()
        return len(text).to_bytes(8, "little") + text + body

    one = {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}
    assert formats.parse_safetensors(made({"__metadata__": {"k": "v"}, "x": one}, bytes(8)))[0][:3] == ("x", "F32", [2])
    for bad in (made({}), made({"__metadata__": {}}), made({"x": one}, bytes(4)), made({"x": one | {"shape": [3]}}, bytes(8)), made({"x": one | {"dtype": "Q9"}}, bytes(8)), made({"x": one | {"data_offsets": [4, 12]}}, bytes(12)), b"\xff" * 9, b""):
        with pytest.raises(ValueError, match=r"header|tensors|unknown type|lies at"):
            formats.parse_safetensors(bad)


def test_json_and_csv_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "ä,\"b\"", None), (2, "x\ny", "z")], "k long, t string, u string")
    b = spark.createDataFrame([(3, 1.5)], "k long, v double")
    sinks.write_json(a, str(tmp_path / "j"))
    sinks.append_json(a.where("k = 1"), str(tmp_path / "j"))
    assert sorted((r["k"], r["t"]) for r in spark.read.json(str(tmp_path / "j")).collect()) == [(1, 'ä,"b"'), (1, 'ä,"b"'), (2, "x\ny")]
    sinks.write_json(a, str(tmp_path / "p"), by="k")
    assert sorted(x.name for x in (tmp_path / "p").glob("k=*")) == ["k=1", "k=2"]
    sinks.write_csv([a, b], str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["k", "t", "u", "v"]
    assert sorted((r["k"], r["t"], r["u"], r["v"]) for r in back.collect()) == [("1", 'ä,"b"', None, None), ("2", "x\ny", "z", None), ("3", None, None, "1.5")]
    assert next((tmp_path / "c").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert json.loads(sinks.bundle(a.select("k", "t"), ["k"], "rows").where("k = 1").first()["rows"]) == [{"t": 'ä,"b"'}]


def test_books_are_split_by_themselves(spark):
    books = [(1, "\nI.\n\na\n\nII.\n\nb\n\nIII.\n\nc\n"), (2, "I\nx\nII\nIII\nz")]
    found = {(r["book"], r["chapter"]): r["text"].strip() for r in segment.split_chapters(spark.createDataFrame(books, "book int, body string")).collect()}
    assert found == {(1, 1): "a", (1, 2): "b", (1, 3): "c", (2, 1): "x", (2, 2): "", (2, 3): "z"}
    for body in ("I.\na\nIII.\nb", "II.\na\nI.\nb\nIII.\nc", "I\nI\nII\nIII"):
        with pytest.raises(Exception, match="headings of a book"):
            segment.split_chapters(spark.createDataFrame([(1, body)], "book int, body string")).collect()


def test_terms_are_words_or_their_beginnings(spark):
    rows = spark.createDataFrame([("the other",), ("other",), ("Prokuristen",), ("xProkurist",), ("Gregors",)], "t string")
    hits = lambda p: [r[0] for r in rows.select(F.col("t").rlike(p)).collect()]
    assert hits(X.term_pattern("the", True)) == [True, False, False, False, False]
    assert hits(X.term_pattern("Prokurist", False)) == [False, False, True, False, False]
    assert hits(X.term_pattern("Gregor", True)) == [False] * 5


def test_ranks_and_pages(spark):
    rows = spark.createDataFrame([(g, v) for g, n in (("a", 7), ("b", 1), (None, 3)) for v in range(n)], "g string, v int").repartition(5)
    got = sorted((r["g"] or "", r["v"], r["rank"]) for r in scratch.group_rank(rows, "g", ["v"]).collect())
    assert all(v == rank for _, v, rank in got) and len(got) == 11
    pages = {}
    for r in ranks.pages_of(rows, "g", ["v"], 3).collect():
        pages.setdefault((r["g"], r["page"]), []).append(r["v"])
    assert sorted(map(len, pages.values())) == [1, 1, 3, 3, 3]
    with pytest.raises(ValueError, match="a page"):
        ranks.pages_of(rows, "g", ["v"], 0)


def test_ticks(spark):
    found = {}
    for r in misc.ticks(spark.createDataFrame([(120, 5), (1, 5), (0, 5), (3, 9), (12_000, 5)], "n int, approx int")).collect():
        found.setdefault(r["n"], []).append(r["tick"])
    assert {n: sorted(t) for n, t in found.items()} == {120: [0, 25, 50, 75, 100, 119], 1: [0], 0: [0], 3: [0, 1, 2], 12_000: [0, 2400, 4800, 7200, 9600, 11_999]}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5)).round(1)
    x[7] = x[40]
    x[9] = 0
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    norms = np.linalg.norm(x, axis=1)
    score = np.round(np.divide(x @ x.T, norms[:, None] * norms[None], out=np.zeros((90, 90)), where=norms[:, None] * norms[None] > 0), 6)
    want = {(q, label, rank + 1): (i, score[q, i]) for q in range(0, 90, 4) for label in range(3) for rank, i in enumerate(sorted(range(label, 90, 3), key=lambda i, q=q: (-score[q, i], i))[:2])}
    got = {(r["query_id"], r["label"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.nearest(rows, rows.where("vec_id % 4 = 0"), 2, block=7, chunk=11).collect()}
    assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
    assert {key: v[1] for key, v in got.items()} == pytest.approx({key: v[1] for key, v in want.items()})


def test_tables_of_merged_scores():
    rng = np.random.default_rng(3)
    s = rng.random((4, 3))
    tables = align.score_tables(s)
    for (i, j), t in tables.items():
        assert t == pytest.approx(np.array([[s[a : a + i, b : b + j].mean() for b in range(3 - j + 1)] for a in range(4 - i + 1)]))
    assert {k: t.shape for k, t in align.score_tables(s[:1, :1]).items()} == {(1, 1): (1, 1), (2, 1): (0, 1), (1, 2): (1, 0), (2, 2): (0, 0)}
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    u = lambda v: v / np.linalg.norm(v)
    assert align.vector_tables(a, b)[2, 1][0, 1] == pytest.approx(u(u(a[0]) + u(a[1])) @ u(b[1]))
