"""Every registered query against its SQL twin, and the shape of its plan."""

import warnings

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from strataflow.catalog import SQL_TWINS, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), SQL_TWINS


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql_twin(spark, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        result = df.toArrow()
    # No product of two tables, and no window over everything in one task.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan
    assert compare(result, con.execute(SQL[name]).to_arrow_table()) == []


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
