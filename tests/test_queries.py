import pytest

import __spark_entry__ as entry
from logweft.plans import queries as log_queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(log_queries.oracle_sql()))
def test_query_agrees_with_sql(spark, small, name):
    compare(spark, small, log_queries.queries()[name], log_queries.oracle_sql()[name])


def test_entry(spark, small):
    rows = entry.entry(spark)
    assert rows.count() == 50 and "message" in rows.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark, small):
    plan = log_queries.cursor_page(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "props" not in plan
    plan = log_queries.filter_levels(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "props" not in plan


def test_a_stored_query_parses_once(spark, small):
    _, events = log_queries._stored(spark, small)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "Exchange" not in plan and "FileScan" in plan
