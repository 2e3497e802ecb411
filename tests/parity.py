"""A query and its SQL side by side: equal columns and equal rows as a multiset, floats to six places."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, bool | datetime.datetime | datetime.date):
        return str(v)
    return f"{v:.6f}" if isinstance(v, float | decimal.Decimal) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def check(spark, sf, query, sql):
    got = query(spark, sf)
    want = duck(sf).execute(sql)
    a, b = rows(got.columns, got.collect()), rows([x[0] for x in want.description], want.fetchall())
    assert a == b
    return len(a[1])
