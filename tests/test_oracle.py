"""Every registered query against its SQL on the smallest tables (rows-only ones must run)."""

import pytest

from candlemill.catalog.compare import check, oracle
from candlemill.catalog.load import queries, sql

QUERIES, SQL = queries(), sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, con, sf_dir):
    ok, message = check(name, QUERIES[name], SQL.get(name), spark, con, sf_dir)
    assert ok, message


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
