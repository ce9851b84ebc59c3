import pytest

from gridloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tiny, name):
    compare(QUERIES[name](spark, tiny), connect(tiny), ORACLE_SQL[name])
