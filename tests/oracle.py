"""Comparison of a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

DATA = os.environ.get("ORRERY_TESTDATA", "/root/testdata/sf0.001")


def database(path: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(path):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def agree(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want
