"""Every registered query with an SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import canonical, connect, run_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    theirs, columns = run_sql(con, entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(theirs, columns)


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
