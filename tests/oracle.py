"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(canon(r[names.index(x)]) for x in columns) for r in found.fetchall()), key=repr)
    assert got == want
