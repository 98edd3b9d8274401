"""Compares a Spark query with its SQL twin in DuckDB."""

import math
import os

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
        return int(x)
    return x if isinstance(x, bool | int | float) else str(x)


def both(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf_dir}/{f}'")
    rel = con.sql(sql)
    columns = list(rel.columns)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr([_plain(r[c]) for c in order]) for r in df.toArrow().to_pylist())
    theirs = sorted(repr([_plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in rel.fetchall())
    return mine, theirs
