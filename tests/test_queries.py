"""Every registered query of the library against its SQL."""

import pytest

from compare import duck_rows, spark_rows
from keidai.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(duck, ORACLE_SQL[name])


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_internal_columns_in_public_results(spark, sf):
    internal = {"score", "pv_base_median", "pv_january", "new_year_ratio"}
    for name in ("search_benefit", "derive_benefits", "official_overrides", "citations_sorted"):
        assert not internal & set(QUERIES[name](spark, sf).columns)
