"""Every registered query: equal to its SQL on sf0.001, and a plan that would scale."""

import re

import pytest

import __spark_entry__ as entry
from workbench.check import difference, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# order matters: a window or sort fed by one partition holds a whole table in one task, unless an
# aggregate below it has left one row per slice
LONE_WINDOW = re.compile(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n(?!(?:[^\n]*Project[^\n]*\n)*[^\n]*HashAggregate)")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not LONE_WINDOW.search(plan)
    rows = spark_rows(df)
    if name in ORACLES:
        assert difference(rows, sql_rows(SF, ORACLES[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
