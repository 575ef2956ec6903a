"""Writers of the library's outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, one folder for each value of `by` if named; characters are kept as they are."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All columns in the order in which they first occur; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """CSV with a header of all frames' columns; nulls are empty. Each file begins with the mark by which spreadsheets
    know UTF-8; quotes inside a field are doubled."""
    whole = union_by_name(frames)
    # The header's first name carries the mark, so the files are written by Spark alone.
    marked = whole.toDF("\ufeff" + whole.columns[0], *whole.columns[1:])
    marked.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').option("quoteAll", False).csv(path)


def bundle(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each key, with the rest of the columns as a compact JSON array, in order of their values."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))
    return df.groupBy(*keys).agg(F.to_json(rows).alias(name))
