"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).split(".")[0]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, c, sf_dir, query, sql) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = c.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} and {len(theirs[1])} rows; only Spark {sorted(a - b, key=repr)[:3]}; only SQL {sorted(b - a, key=repr)[:3]}"
    return ""
