"""Runs catalogue queries beside their SQL in DuckDB over one folder of tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def difference(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns and rows."""
    df = run(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return None
    mine, other = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
    return f"{len(ours)} rows and {len(theirs)}; only here {mine}, only there {other}"
