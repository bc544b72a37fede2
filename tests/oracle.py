"""Runs a query and its SQL over the same tables and compares rows."""

from __future__ import annotations

import math
import os


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def connection(folder):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c


def same(spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    rel = connection(folder).sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
