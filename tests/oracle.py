"""Runs a registered query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        assert not math.isnan(x), "NaN must not leave a query"
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_flat(spark, query, sql: str, sf_dir: str, key: list[str]) -> int:
    """For results of so many rows that Python objects for each are slow: numbers only, sorted by key and compared as arrays."""
    df = query(spark, sf_dir)
    got = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    a, b = (x.sort_by([(k, "ascending") for k in key]) for x in (df.toArrow(), got.to_arrow_table()))
    assert a.num_rows == b.num_rows
    for c in df.columns:
        x, y = a[c].to_numpy().astype(float), b[c].to_numpy().astype(float)
        bad = np.flatnonzero(~(np.abs(x - y) <= 1e-5))
        assert not len(bad), f"{len(bad)} of {len(x)} rows differ in {c}, as {x[bad[:3]]} and {y[bad[:3]]}"
    return a.num_rows


def same(spark, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    con = connection(sf_dir)
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns), (sorted(df.columns), sorted(got.columns))
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(got.columns, got.fetchall())
    assert len(a) == len(b), f"{len(a)} rows, SQL gives {len(b)}; first {a[:2]} against {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, f"{len(bad)} of {len(a)} rows differ, as {bad[:3]}"
    return len(a)
