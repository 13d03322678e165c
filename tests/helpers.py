"""Comparing rows of Spark and DuckDB."""

from __future__ import annotations

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(canonical, v))
    return "null" if v is None else v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr([canonical(r[c]) for c in columns]) for r in df.collect())


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[str]]:
    """Column names and rows of DuckDB over the tables of a folder."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([canonical(r[i]) for i in order]) for r in out.fetchall())
