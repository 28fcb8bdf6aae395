"""Every catalogue query against DuckDB on the small tables; those without SQL only have to run."""

import pytest

from tests.compare import database, difference
from viaduct.plans import registry

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(TABLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert difference(spark, con, QUERIES[name], SQL[name], TABLES) is None
    else:
        assert QUERIES[name](spark, TABLES).count() >= 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
