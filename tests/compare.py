"""Spark results against DuckDB on the same tables."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def views(d=SF):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == math.floor(v) and abs(v) < 2**53 else round(v, 5)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def same(spark, queries, sql, name, d=SF):
    a, b = queries[name](spark, d).toPandas(), views(d).execute(sql[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
