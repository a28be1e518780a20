"""The driver's gate, run locally: every registered query against its DuckDB oracle SQL."""

import pytest

from conftest import SF_ORACLE
from oracle_check import check


@pytest.fixture(scope="module")
def results(spark):
    """The shop's queries; those of the training-data operators are compared in their own tests."""
    from tillbook.registry import QUERIES
    return check(spark, SF_ORACLE, names=set(QUERIES), verbose=False)


def test_every_shop_query_has_an_oracle():
    from tillbook.oracle_sql import ORACLE
    from tillbook.registry import QUERIES
    assert sorted(set(QUERIES) - set(ORACLE)) == []


def test_entry_lists_every_shop_query():
    import __spark_entry__ as entry
    from tillbook.registry import QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_every_query_matches_its_oracle(results):
    bad = {k: v for k, v in results.items() if v["match"] is not True}
    assert bad == {}


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "name", "description", "current_stock", "total_sales", "revenue"]
