"""Tables are published if their invariants hold, and not at all if not."""

import pytest
from pyspark.sql import functions as F

from loomtext.sources import contracts



@pytest.fixture
def rules(spark):
    return {"v is positive": F.col("v") > 0, "k is named": F.col("k") != ""}


def test_only_whole_tables_that_hold_are_published(spark, tmp_path, rules):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int").repartition(3)
    with pytest.raises(contracts.Violated, match="2 rows against: v is positive") as told:
        contracts.write_checked(good.union(spark.createDataFrame([("d", 0), ("e", None), ("", 4), (None, 5)], "k string, v int")), path, rules)
    assert told.value.counts == {"v is positive": 2, "k is named": 2} and not list(tmp_path.iterdir())
    with pytest.raises(contracts.Violated, match="sum is 7"):
        contracts.write_checked(good, path, rules, {"sum is 7": F.sum("v") == 7})
    assert not list(tmp_path.iterdir())
    assert contracts.write_checked(good, path, rules, {"sum is 6": F.sum("v") == 6}) == {"rows": 3, "v is positive": 0, "k is named": 0, "sum is 6": 0}
    assert spark.read.parquet(path).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["t"]
    with pytest.raises(FileExistsError):
        contracts.write_checked(good, path, rules)


def test_empty_tables(spark, tmp_path, rules):
    none = spark.createDataFrame([], "k string, v int")
    assert contracts.write_checked(none, str(tmp_path / "a"), rules)["rows"] == 0
    with pytest.raises(contracts.Violated, match="some rows"):
        contracts.write_checked(none, str(tmp_path / "b"), rules, {"some rows": F.count(F.lit(1)) > 0})
