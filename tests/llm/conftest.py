import random

import pytest

WORDS = ["".join(p) for p in zip("abcdefghijklmnopqrstuvwxyz" * 4, "nopqrstuvwxyzabcdefghijklm" * 4, "aeiou" * 21, strict=False)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null, empty, blank, short, long, repeated and tied texts; null and repeated ids; columns with internal names."""
    base, shared = prose(1, 120), prose(2, 30)
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, prose(3, 80) + "\n" + shared),
        (9, shared + " " + prose(4, 60)), (10, prose(5, 20_000)), (11, "x" * 50_000), (11, "x" * 50_000), (12, prose(6, 70)), (12, prose(7, 70)), (None, prose(8, 60)), (None, None),
        (13, "line\nline\nline\nother"), (14, "a b c a b c a b c " * 20), (15, "ÄÖ ß éè 漢字   　 😀 ctrl\x01"),
    ]
    return [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t) if t else None, 1, "x", 2.0) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d int, key string, rep double"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """The documents of the smallest tables, as rows and as a DataFrame."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, [(r["doc_id"], r["text"] or "") for r in df.orderBy("doc_id").collect()]
