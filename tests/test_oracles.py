"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.oracles import ORACLES as STATEMENTS
from registry.queries import QUERIES
from compare import difference, open_tables





@pytest.fixture(scope="module")
def tables(folder):
    return open_tables(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, tables):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
    if name in STATEMENTS:
        assert difference(df, tables, STATEMENTS[name]) is None
    else:
        assert df.count() > 0


def test_no_statement_without_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
