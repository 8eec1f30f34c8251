"""Holds a query's rows against its SQL."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, df.collect()) == want
