"""Every query of the library against its oracle, on the smallest tables."""

import pytest

from loomtext.plans import catalog

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_oracle(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_oracles_name_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
