"""Rows of a query against those of its SQL in DuckDB, without order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, list) else v


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    found = [c[0] for c in cur.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want
