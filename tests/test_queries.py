"""Every registered query against its SQL on the smallest tables."""

import pytest

import workload
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    q = workload.QUERIES[name]
    df = q.run(spark, SF)
    if q.sql:
        assert differences(df, con, q.sql) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
