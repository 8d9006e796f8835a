"""Every registered query against its DuckDB text on the smallest tables; those without one must give rows twice alike."""

import pytest
from tidewell.plans import compare, registry


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    if name in registry.ORACLE_SQL:
        assert compare.differences(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name]) is None
    else:
        one, two = (registry.QUERIES[name](spark, sf) for _ in range(2))
        assert compare.rows_of(one.columns, one.collect()) == compare.rows_of(two.columns, two.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
