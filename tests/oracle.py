"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    cols = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    told = sorted((tuple(_plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    if len(mine) != len(told):
        return f"rows {len(mine)} and {len(told)}: {mine[:2]} {told[:2]}"
    bad = [(a, b) for a, b in zip(mine, told, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:2]}" if bad else ""
