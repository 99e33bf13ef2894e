"""Run every registered query beside its SQL and compare rows, columns and types.

    python check_oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from lucidex.plans.catalog import ORACLES, QUERIES
from lucidex.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8)
    con = duckdb.connect()
    for table in TABLES:
        try:
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        except duckdb.Error:
            pass
    failed = []
    for name in names:
        started = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            columns = sorted(frame.columns)
            rows = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows {name:24} {len(rows):6} {took:5.1f}s", flush=True)
                continue
            result = con.sql(ORACLES[name])
            position = {c: i for i, c in enumerate(result.columns)}
            types = dict(zip(result.columns, map(str, result.types)))
            if sorted(position) != columns:
                raise AssertionError(f"columns {columns} != {sorted(position)}")
            wanted = [tuple(plain(row[position[c]]) for c in columns) for row in result.fetchall()]
            odd = {c: (t, types[c]) for c, t in frame.dtypes if TYPES.get(t, t) != types[c]}
            key = lambda row: tuple((v is None, str(v)) for v in row)
            rows.sort(key=key)
            wanted.sort(key=key)
            same = rows == wanted
            print(f"{'ok  ' if same else 'DIFF'} {name:24} {len(rows):6} {took:5.1f}s {odd or ''}", flush=True)
            if not same:
                failed.append(name)
                print("   columns", columns, "rows", len(rows), len(wanted))
                shown = 0
                for a, b in zip(rows, wanted):
                    if a != b and shown < 2:
                        print("   spark ", str(a)[:700], "\n   duckdb", str(b)[:700])
                        shown += 1
        except Exception as problem:  # report and go on with the next query
            failed.append(name)
            print(f"FAIL {name}: {type(problem).__name__} {str(problem)[:900]}", flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
