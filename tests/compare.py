"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    assert sorted(df.columns) == sorted(names)
    mine, other = rows_of(df.columns, df.collect()), rows_of(names, theirs.fetchall())
    assert len(mine) == len(other), (len(mine), len(other))
    for a, b in zip(mine, other, strict=True):
        assert a == b, (a, b)
    return len(mine)
