"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _norm(value):
    return round(value, 6) if isinstance(value, float) else value


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in columns) for r in df.collect()]
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(_norm(r[i]) for i in at) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
