"""Compare every registered query with its SQL in DuckDB: python tests/check_oracle.py [sf] [name-prefix...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from chronoflux.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(value):
    if value is None:
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        value = float(value)
        if math.isnan(value):
            return ""
        return repr(0.0 if value == 0 else value)
    return str(value)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(normal(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None))


def compare(spark, folder, name, fn, sql, con):
    started = time.time()
    mine = fn(spark, folder)
    types = dict(mine.dtypes)
    mine = mine.toPandas()
    took = time.time() - started
    if sql is None:
        return ("rows-only", len(mine) > 0, took, f"{len(mine)} rows")
    theirs = con.execute(sql).df()
    cols_a, a = rows_of(mine)
    cols_b, b = rows_of(theirs)
    if cols_a != cols_b:
        return ("oracle", False, took, f"columns {cols_a} != {cols_b}")
    for c in cols_a:
        if str(mine[c].dtype) != str(theirs[c].dtype):
            kinds = (str(mine[c].dtype), str(theirs[c].dtype))
            if a != b or not {k.rstrip("0123456789") for k in kinds} <= {"int"}:
                return ("oracle", False, took, f"type of {c}: {kinds} spark {types[c]}")
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return ("oracle", False, took, f"rows {len(a)} vs {len(b)}; first differences {diff}")
    return ("oracle", len(a) > 0, took, f"{len(a)} rows")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    spark = local_session(8)
    oracle = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            kind, ok, took, note = compare(spark, folder, name, fn, oracle.get(name), con)
        except Exception as exc:  # noqa: BLE001
            kind, ok, took, note = "error", False, 0.0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:44s} {kind:9s} {took:6.2f}s {note}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
