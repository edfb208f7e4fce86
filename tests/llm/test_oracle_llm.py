import pytest
from oracle import compare

from tessera.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    compare(spark, data, QUERIES[name], SQL[name])
