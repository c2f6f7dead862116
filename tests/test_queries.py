"""Every registered query against its SQL on the smallest tables."""

import pytest

from docstrata.plans import registry
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    names, expected = sql_rows(SF, registry.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
