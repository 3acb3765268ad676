"""A query's rows against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(sf).iterdir():
        con.execute(f"create view {f.name.split('.')[0]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == wanted
