"""Runs a query and its SQL and compares the rows."""

import os

import duckdb


def _plain(v):
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else repr(v)


def rows_of(df):
    order = sorted(range(len(df.columns)), key=df.columns.__getitem__)
    return sorted(df.columns), sorted(tuple(_plain(r[i]) for i in order) for r in df.collect())


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
