"""Rows of a Spark query and of its SQL in DuckDB, as comparable lists."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.10g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, connection, sql):
    columns = sorted(df.columns)
    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = connection.sql(sql)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    right = sorted(repr(tuple(plain(r[i]) for i in places)) for r in found.fetchall())
    assert left == right
    return len(left)
