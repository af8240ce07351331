"""Run registered queries on Spark and their SQL on DuckDB over the same tables and compare.

    python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from glob import glob

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterspark import registry  # noqa: E402
from rasterspark.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else value + 0.0
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when equal, else what differs."""
    got = registry.QUERIES[name](spark, sf_dir)
    got_rows = sorted((tuple(_plain(v) for v in (r[c] for c in sorted(got.columns))) for r in got.collect()), key=repr)
    if name not in registry.SQL:
        return f"rows-only ({len(got_rows)})" if got_rows else "NO ROWS"
    relation = con.execute(registry.SQL[name])
    columns = [d[0] for d in relation.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want_rows = sorted((tuple(_plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)
    if sorted(got.columns) != sorted(columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(columns)}"
    if len(got_rows) != len(want_rows):
        return f"ROWS {len(got_rows)} vs {len(want_rows)}"
    bad = [(a, b) for a, b in zip(got_rows, want_rows) if a != b]
    if bad:
        return f"VALUES {len(bad)} differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    types = [type(v).__name__ for v in (got_rows[0] if got_rows else ())]
    want_types = [type(v).__name__ for v in (want_rows[0] if want_rows else ())]
    if types != want_types:
        return f"TYPES {types} vs {want_types}"
    return "" if got_rows else "EMPTY"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--match", default="")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    registry.load()
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in args.names or [n for n in registry.QUERIES if args.match in n]:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - reported, and the others still run
            problem = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        ok = problem == "" or problem.startswith("rows-only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
