"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as se
from issuelens.plans import registry
from issuelens.plans.compare import compare, duck

from .conftest import SF_SMALL

QUERIES = se.queries()
ORACLES = se.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert sorted(registry.queries()) == sorted(registry.oracles())
    assert len(registry.queries()) >= 100
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare(df, con, ORACLES[name]) == []


def test_entry(spark):
    df = se.entry(spark)
    assert df.columns == ["query_id", "rank", "key", "similarity", "issuetype"]
    assert df.count() > 0
