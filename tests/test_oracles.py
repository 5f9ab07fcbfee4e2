"""Every query that SQL can express, against DuckDB on the same files."""

import pytest

from measurelake.plans import registry

from .oracle import check

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    check(spark, SF, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"random_forest", "panel_subset_sweep"}))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
