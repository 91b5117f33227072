"""Every query of the core against its SQL, and every other one for rows and a stable schema."""

import pytest
from conftest import same_rows

from kgspark import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, duck, name):
    same_rows(registry.QUERIES[name](spark, data), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
