"""Comparison of a query with its SQL, for tests."""

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = con.execute(sql)
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert got == want
