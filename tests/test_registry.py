"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from registry import compare
from tests.conftest import SF_DIR

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, con):
    df = QUERIES[name](spark, SF_DIR)
    assert compare.difference(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark):
    df = QUERIES[name](spark, SF_DIR)
    assert len(df.collect()) > 0
    assert len(set(df.columns)) == len(df.columns)
