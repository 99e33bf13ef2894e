"""Every registered query runs; those with SQL agree with it (smallest sample)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract
from lucidex.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents events pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in row)


def in_order(rows):
    return sorted(map(plain, rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(row[c] for c in columns) for row in frame.collect()]
    statement = ORACLES.get(name)
    if statement is None:
        assert got
        return
    result = duck.sql(statement)
    place = {c: i for i, c in enumerate(result.columns)}
    assert sorted(place) == columns
    assert in_order(got) == in_order([tuple(row[place[c]] for c in columns) for row in result.fetchall()])


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert contract.queries().items() >= QUERIES.items() and contract.oracle_sql().items() >= ORACLES.items()
