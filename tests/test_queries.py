"""Every registered query of the engine against its SQL, and the entry module's contract."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framefold.plans import queries as engine


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 5)
    return str(value) if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", engine.ORACLE_SQL)
def test_query_is_its_sql(spark, sql, sf_dir, name):
    frame = engine.QUERIES[name](spark, sf_dir)
    expected = sql.sql(engine.ORACLE_SQL[name])
    names = sorted(frame.columns)
    assert sorted(expected.columns) == names
    at = [expected.columns.index(n) for n in names]
    got = sorted(repr([plain(r[n]) for n in names]) for r in frame.collect())
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in expected.fetchall())


@pytest.mark.parametrize("name", [n for n in engine.QUERIES if n not in engine.ORACLE_SQL])
def test_other_queries_run(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert engine.QUERIES.keys() <= entry.queries().keys() and engine.ORACLE_SQL.keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = engine.QUERIES["a1_percentiles"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    plan = engine.QUERIES["t1_leaderboard"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
