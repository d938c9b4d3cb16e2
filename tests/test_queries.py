"""Every registered query of the library proper against its SQL."""

import pytest

from lorekeep.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, oracle, same, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        same(df, oracle.sql(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
