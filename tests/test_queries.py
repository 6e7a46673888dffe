"""Every query with SQL gives the same rows as DuckDB does; the others give rows."""

import compare
import pytest

from tideline.plans import catalog

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert compare.differences(catalog.QUERIES[name](spark, DATA), catalog.SQL[name], DATA) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["symbol", "day"]
    assert set(e.oracle_sql()) <= set(e.queries())
