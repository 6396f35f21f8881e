"""Queries that SQL expresses."""

import pytest

from compare import duck_rows, spark_rows
from keidai.llm import registry


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duck_rows(duck, registry.ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
