"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v.item() if hasattr(v, "item") else v


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if rows and column names agree, else what differs."""
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{name}: {len(got)} and {len(want)} rows, first differences {odd}"
    return ""
