"""Compare a registered query with its SQL in DuckDB: same columns, same rows, any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def _plain(value):
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def differences(df, sql: str, sf_dir: str) -> list[str]:
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    want = _rows(names, found.fetchall())
    got = _rows(df.columns, df.collect())
    out = [f"only in spark: {str(r)[:600]} x{n}" for r, n in list((got - want).items())[:3]]
    out += [f"only in sql: {str(r)[:600]} x{n}" for r, n in list((want - got).items())[:3]]
    if out:
        out.append(f"{sum(got.values())} rows against {sum(want.values())}; {sum((got - want).values())} differ")
    return out
