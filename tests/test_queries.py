"""Every query with SQL equals it; the others give rows."""

import pytest

from oracle import check
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    check(registry.QUERIES[name](spark, sf).toArrow(), registry.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
