"""Compares every query with its SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """Problem text, or None when both sides agree; with the row count."""
    frame = fn(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None, len(got)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(got)
    want = rows_of(names, cursor.fetchall())
    if got == want:
        return None, len(got)
    extra = [r for r in got if r not in set(want)][:3]
    lost = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows != {len(want)}; only here {extra}; only there {lost}", len(got)


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, fn, entry.oracle_sql().get(name))
        except Exception as exc:
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
