"""Cases that are told by hand: operators over inline rows, against the rows that are expected."""

import pytest

import told_queries
from compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", list(told_queries.QUERIES))
def test_rows_are_as_told(spark, duck, sf, name):
    assert spark_rows(told_queries.QUERIES[name](spark, sf)) == duck_rows(duck, told_queries.SQL[name])
