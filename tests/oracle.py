"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') if os.path.isdir(path) else [path]})")
    return c


def key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in row)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols, name
    want = sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (name, a, b)
