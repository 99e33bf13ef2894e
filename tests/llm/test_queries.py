"""Every registered query runs over its whole tables; those with SQL agree with it (smallest sample)."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from lucidex.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=str)
    if not name.startswith(("op11", "op12")):
        assert len(got) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    if name in ORACLES:
        result = duck.sql(ORACLES[name])
        place = {c: i for i, c in enumerate(result.columns)}
        assert sorted(place) == columns
        assert got == sorted([tuple(r[place[c]] for c in columns) for r in result.fetchall()], key=str)


def test_numbers():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES
