"""Runs registered queries next to their DuckDB text and compares whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value))
    return (3, f"{type(value).__name__}:{value}")


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def compare(df, con, text) -> str:
    """Empty text when equal, else what differs."""
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    for name, kind in df.dtypes:
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}.get(kind)
        if same and same != types[name]:
            return f"type of {name}: {kind} vs {types[name]}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(got_cols)
        x, y = bad[0]
        diff = [(n, i[1], j[1]) for n, i, j in zip(names, x, y) if i != j]
        return f"{len(bad)} of {len(a)} rows differ, first {diff} in {x}"
    return ""


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from gaugeline.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = sys.argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, run in queries.items():
        if names and not any(key.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            df = run(spark, sf)
            if key not in oracles:
                rows = df.collect()
                print(f"{key}: rows-only {len(rows)} ({time.time() - started:.1f}s)", flush=True)
                if os.environ.get("SHOW"):
                    print(rows[:3])
                continue
            result = compare(df, con, oracles[key])
            count = "" if result else f" {df.count() if os.environ.get('COUNT') else ''}"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(result)
        print(f"{key}: {'ok' + count if not result else 'BAD ' + result} ({time.time() - started:.1f}s)", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
