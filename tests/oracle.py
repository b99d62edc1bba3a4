"""Order-insensitive comparison of a query with its SQL twin."""

import glob
import math
import os

import duckdb


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else bytes(v) if isinstance(v, (bytearray, memoryview)) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, sf)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, exp = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(exp), (len(got), len(exp))
    for a, b in zip(got, exp, strict=True):
        assert a == b
