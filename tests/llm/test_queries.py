"""The queries that SQL can express, against it."""

import pytest

from loomtext.llm import queries

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
