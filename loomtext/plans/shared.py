"""Queries whose SQL both engines read: {name} is a view, bound to a DataFrame here and to a table expression in the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.plans.registry import query
from loomtext.sources import tables as T

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "paragraphs": T.paragraphs,
    "sentences": T.sentences,
    "sides": T.conversation_sides,
    "log": T.log_view,
    "tokens": T.tokens,
} | {n: (lambda spark, sf_dir, n=n: T.table(spark, sf_dir, n)) for n in BASE}
PRELUDES = {"paragraphs": T.PARAGRAPHS_SQL, "sentences": T.SENTENCES_SQL, "sides": T.SIDES_SQL, "log": T.LOG_SQL, "tokens": T.TOKENS_SQL}


def names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql, **{n: VIEWS[n](spark, sf_dir) for n in names(sql)})


def oracle(sql: str) -> str:
    """The same for DuckDB: views become common table expressions before those that the query has itself."""
    used = set(names(sql))
    if "sentences" in used:
        used.discard("paragraphs")
    prelude = ",".join(PRELUDES[n] for n in sorted(used) if n in PRELUDES)
    text = sql
    for n in names(sql):
        text = text.replace("{" + n + "}", n)
    if not prelude:
        return text
    return f"WITH {prelude}, {text[5:]}" if text.startswith("WITH ") else f"WITH {prelude} {text}"


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query; duck: the oracle's SQL where the dialects differ."""
    query(oracle(duck or sql), name)(lambda spark, sf_dir: run(sql, spark, sf_dir))


def shared_all(queries: dict[str, str | tuple[str, str]]) -> None:
    for name, sql in queries.items():
        shared(name, *((sql,) if isinstance(sql, str) else sql))
