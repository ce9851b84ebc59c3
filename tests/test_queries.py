import pytest

from gridloom.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def db(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tiny, db, name):
    compare(QUERIES[name](spark, tiny), db, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_gives_the_same_rows_twice(spark, tiny, name):
    first, second = (sorted(map(str, QUERIES[name](spark, tiny).collect())) for _ in range(2))
    assert first and first == second


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 11
