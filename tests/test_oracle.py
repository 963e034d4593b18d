"""Every query with a SQL twin against DuckDB on the smallest tables."""

import pytest

from chartline.catalog import base, load

from . import oracle

FOLDER = f"{oracle.ROOT}/sf0.001"
WITH_SQL = [n for n, q in load().items() if q.sql]


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equal(name, spark, con):
    q = load()[name]
    df = q.run(base.Tables(spark, FOLDER))
    msg, _ = oracle.compare(df, con, q.sql)
    assert not msg, msg
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
