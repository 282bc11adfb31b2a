"""Run registered queries and their DuckDB counterparts side by side and compare values.

Usage: python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", 0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a text that shows the difference."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if len(got) > 0 else "no rows", len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; only spark {sorted(a - b, key=repr)[:2]}; only sql {sorted(b - a, key=repr)[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        a, b = set(got), set(want)
        return f"{len(bad)} rows differ, {len(a - b)} values; spark {sorted(a - b, key=repr)[:2]} sql {sorted(b - a, key=repr)[:2]}", len(got)
    return None, len(got)


def main():
    from offerloom import plans, registry
    from offerloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    plans.load()
    spark, con = local_session(), connect(sf_dir)
    n_bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, fn, registry.ORACLES.get(name))
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        kind = "sql" if name in registry.ORACLES else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {name} [{kind}] rows={n} {time.time() - t:.1f}s {problem or ''}", flush=True)
        n_bad += problem is not None
    print(f"{n_bad} bad")


if __name__ == "__main__":
    main()
