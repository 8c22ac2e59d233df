"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return str(x) if x is not None and not isinstance(x, (int, str)) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    rel = con.execute(sql)
    want_columns = [d[0] for d in rel.description]
    want = rows(want_columns, rel.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want_columns), (df.columns, want_columns)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got)


def sf(name="sf0.01"):
    found = glob.glob(f"/root/testdata/{name}")
    return found[0] if found else None
