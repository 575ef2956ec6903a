"""The Python data sources: what is written is read back, in ranges, with filters pushed down, and faults are told."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.sources import datasource, formats


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    return spark


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_charset(known, tmp_path):
    rows = [("a/1.txt", "むりだ。\n次"), ("a/2.txt", ""), ("b.txt", "plain"), ("c.txt", None)]
    known.createDataFrame(rows, "path string, text string").repartition(3).write.format("loomtext_charset").mode("append").save(str(tmp_path / "t"))
    read = known.read.format("loomtext_charset").load(str(tmp_path / "t"))
    assert [(r["path"].removeprefix(f"{tmp_path}/t/"), r["text"]) for r in read.collect()] == [(p, t or "") for p, t in rows]
    some = read.where(F.col("path").endswith("/2.txt") | (F.col("path") == "x"))
    assert some.count() == 1
    one = read.where(F.col("path").contains("/a/") & F.col("path").endswith("1.txt"))
    assert [r["text"] for r in one.collect()] == ["むりだ。\n次"] and "Filter path" not in plan(one) and "Filter (" not in plan(one)
    (tmp_path / "t" / "bad.txt").write_bytes(b"\x81")
    assert read.where(F.col("path").startswith(f"{tmp_path}/t/a")).count() == 2
    with pytest.raises(Exception, match="decode"):  # a new load, as the list of files is made once for each
        known.read.format("loomtext_charset").load(str(tmp_path / "t")).collect()
    with pytest.raises(Exception, match="encode"):
        known.createDataFrame([("d.txt", "ä"), ("e.txt", "fine")], "path string, text string").coalesce(1).write.format("loomtext_charset").mode("append").save(str(tmp_path / "u"))
    assert not list((tmp_path / "u").glob("[!.]*"))
    with pytest.raises(Exception, match="no name"):
        known.createDataFrame([("../d.txt", "a")], "path string, text string").write.format("loomtext_charset").mode("append").save(str(tmp_path / "u"))
    with pytest.raises(Exception, match="nowhere"):
        known.read.format("loomtext_charset").load(str(tmp_path / "nowhere")).count()


def test_npy_in_ranges_of_rows(known, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 7)).astype("<f4")
    rows = [(f"{'odd' if i % 2 else 'even'}.npy", i, x[i].tolist()) for i in range(1000)]
    df = known.createDataFrame(rows, "path string, i int, values array<float>")
    df.repartition("path").sortWithinPartitions("path", "i").select("path", "values").write.format("loomtext_npy").mode("append").save(str(tmp_path / "v"))
    assert (np.load(tmp_path / "v" / "odd.npy") == x[1::2]).all()
    read = known.read.format("loomtext_npy").option("split", 28 * 64).load(str(tmp_path / "v"))
    assert read.rdd.getNumPartitions() == 16
    got = {(r["path"].rpartition("/")[2], r["row"]): r["values"] for r in read.collect()}
    assert len(got) == 1000 and all(got["even.npy", k] == x[2 * k].tolist() for k in range(500))
    np.save(tmp_path / "i.npy", np.arange(6, dtype="<i2").reshape(3, 2))
    assert [r["values"] for r in known.read.format("loomtext_npy").load(str(tmp_path / "i.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    for name, bad in (("f", np.asfortranarray(x[:5])), ("one", x[0]), ("text", np.array([["a"]]))):
        np.save(tmp_path / f"{name}.npy", bad)
        with pytest.raises(Exception, match="rows of numbers"):
            known.read.format("loomtext_npy").load(str(tmp_path / f"{name}.npy")).count()
    (tmp_path / "short.npy").write_bytes((tmp_path / "v" / "odd.npy").read_bytes()[:-3])
    with pytest.raises(Exception, match="has .* bytes"):
        known.read.format("loomtext_npy").load(str(tmp_path / "short.npy")).count()


def test_float32_and_safetensors(known, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(20, 3)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "v.f32").write_bytes(x.tobytes())
    (tmp_path / "raw" / "_note").write_bytes(b"1")
    read = known.read.format("loomtext_float32").option("width", 3).option("split", 50).load(str(tmp_path / "raw"))
    assert [r["values"] for r in read.orderBy("row").collect()] == x.tolist() and read.rdd.getNumPartitions() == 5
    with pytest.raises(Exception, match="no rows of 7"):
        known.read.format("loomtext_float32").option("width", 7).load(str(tmp_path / "raw")).count()
    (tmp_path / "m.safetensors").write_bytes(formats.write_safetensors({"w": x, "n": np.arange(4, dtype="<i8")}))
    got = {r["name"]: (r["dtype"], r["shape"], r["data"]) for r in known.read.format("loomtext_safetensors").load(str(tmp_path / "m.safetensors")).collect()}
    assert got["w"] == ("F32", [20, 3], bytearray(x.tobytes())) and got["n"][:2] == ("I64", [4])
    (tmp_path / "empty").mkdir()
    assert known.read.format("loomtext_safetensors").load(str(tmp_path / "empty")).count() == 0
