"""Run a query on Spark and its SQL on DuckDB over the same files; say where they differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_cell(r[k]) for k in order) for r in rows), key=repr)


def difference(spark, sf_dir: str, plan, sql: str) -> str:
    """Empty if names and rows are equal."""
    df = plan(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = database(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = ([r for r in x if r not in set(y)][:2] for x, y in ((got[1], want[1]), (want[1], got[1])))
    return f"{len(got[1])} and {len(want[1])} rows; only Spark: {str(a)[:600]}; only SQL: {str(b)[:600]}"
