"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null" if v is None else "nan"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kinds(columns, rows):
    out = {}
    for i, c in enumerate(columns):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out[c] = seen
    return out


def differences(spark, folder, fn, sql):
    """Empty when equal, else a short description."""
    df = fn(spark, folder)
    got = df.collect()
    cur = connect(folder).execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = canonical(df.columns, got), canonical(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {bad[:2]}"
    ka, kb = kinds(df.columns, got), kinds(names, want)
    if ka != kb:
        return f"types {[(c, ka[c], kb[c]) for c in ka if ka[c] != kb[c]]}"
    return ""
