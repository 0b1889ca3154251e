import pytest

import __spark_entry__ as entry
from ferrolith.plans import catalog
from tests.conftest import against_duckdb

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found, want = against_duckdb(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
