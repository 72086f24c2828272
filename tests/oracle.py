"""Compares a query with its DuckDB oracle, as rows without order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None:
        return None
    if hasattr(x, "item") and getattr(x, "ndim", 0) == 0:
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 6)
    if hasattr(x, "tolist"):
        return str(x.tolist())
    return None if str(x) in ("<NA>", "NaT") else x


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


def assert_same(spark, sf_dir, query, sql) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
