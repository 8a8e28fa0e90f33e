"""Compares queries with their SQL on DuckDB: row counts, columns, values in any order."""

from __future__ import annotations

import collections
import datetime
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, sf_dir: str, make, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = make(spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = collections.Counter(tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall())
    got = collections.Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    return "" if got == want else f"{sum(got.values())} rows and {sum(want.values())}; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
