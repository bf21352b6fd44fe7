import pytest

from oracle import compare
from triagewright.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 14)] == [1] * 13
