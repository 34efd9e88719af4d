"""Every query of the core against its SQL on the smallest tables."""

import pytest

from versloom.plans.oracle import ORACLE_SQL
from versloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, folder, duck, same_rows):
    same_rows(QUERIES[name](spark, folder), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, folder):
    df = QUERIES[name](spark, folder)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
