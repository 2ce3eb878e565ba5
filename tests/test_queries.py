"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from wayloom import plans

NAMES = sorted(plans.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in plans.oracle_sql()])
def test_same_rows_as_sql(spark, data, duck, same, name):
    got = plans.queries()[name](spark, data).toPandas()
    assert same(got, duck.execute(plans.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in plans.oracle_sql()])
def test_runs(spark, data, name):
    assert plans.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
