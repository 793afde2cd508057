"""Runs a query and its SQL over the same tables and compares columns, row counts and values."""

from __future__ import annotations

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "float": "double", "double": "double", "string": "text", "varchar": "text", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "timestamp_ns": "timestamp"}


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    out = connection(sf_dir).sql(sql)
    theirs = rows(out.columns, out.fetchall())
    if sorted(df.columns) != sorted(out.columns):
        return f"columns {sorted(df.columns)} and {sorted(out.columns)}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}, {c: KINDS.get(str(t).lower(), str(t).lower()) for c, t in zip(out.columns, out.types)}
    if kinds[0] != kinds[1]:
        return f"types differ: {[(c, t, kinds[1][c]) for c, t in kinds[0].items() if t != kinds[1][c]]}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; only ours: {[x for x in ours if x not in set(theirs)][:3]}; only SQL: {[x for x in theirs if x not in set(ours)][:3]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else ""
