"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert len(frame.columns) == len(set(frame.columns))
    frame.collect()


def test_entry(spark):
    assert entry(spark).columns == ["section", "kind", "subject", "value", "score"]
    assert entry(spark).count() > 0
