"""Every registered query against DuckDB on the small tables."""

import pytest

from cohortscore.plans import registry

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
