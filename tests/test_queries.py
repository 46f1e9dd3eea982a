"""Every query of the core against its SQL; those without SQL run and keep their columns."""

import compare
import pytest
from partmill.plans import catalog_queries, general_queries

QUERIES = {**catalog_queries.QUERIES, **general_queries.QUERIES}
ORACLE = {**catalog_queries.ORACLE, **general_queries.ORACLE}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    names, expected = compare.sql_rows(ORACLE[name], data)
    assert sorted(df.columns) == names
    assert compare.spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["snapshot_id", "part_no", "change_kind"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
