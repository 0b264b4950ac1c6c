"""Every query with a statement agrees with DuckDB on the smallest data; every other one runs."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime.date):
        return str(v)[:26]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(columns, table, order):
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_agrees(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == order
    assert rows(df.columns, df.collect(), order) == rows(theirs, cursor.fetchall(), order)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and not n.startswith("p")))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["from_table", "row_id", "col_name", "reason"]
