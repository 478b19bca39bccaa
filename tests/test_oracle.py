"""Every query against its SQL twin on the smallest tables; every query runs."""

import pytest
from helpers import SMALL, assert_same

import __spark_entry__ as entry_point
from codeloom import queries as engine


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(name, spark, duck):
    assert_same(engine.QUERIES[name](spark, SMALL), duck, engine.SQL[name])


@pytest.mark.parametrize("name", sorted(engine.QUERIES.keys() - engine.SQL.keys()))
def test_query_without_sql_runs(name, spark):
    assert engine.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
    assert entry_point.oracle_sql().keys() <= entry_point.queries().keys()


def test_issue_cap50_reads_every_file(spark, duck):
    """All files, and the cap bites."""
    got = engine.QUERIES["issue_cap50"](spark, SMALL)
    assert_same(got, duck, engine.SQL["issue_cap50"])
    assert got.selectExpr("file_id % 20").distinct().count() > 1
    assert got.where("code not in ('NO_VAR', 'CONSOLE_LOG', 'LOOSE_EQ')").groupBy("file_id").sum("n").where("`sum(n)` > 50").count() == 0
