"""Side-by-side check used by the tests: Spark rows against DuckDB rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, repr(v))
    if isinstance(v, (list, tuple)):
        return (2, str([_cell(x) for x in v]))
    return (1, str(v))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str, left=None):
    """None when both agree, else a short description."""
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(names)}"
    right = rel.fetchall()
    left = [tuple(r) for r in (spark_df.collect() if left is None else left)]
    if len(left) != len(right):
        return f"row counts differ: {len(left)} vs {len(right)}"
    a, b = canonical(left, spark_df.columns), canonical(right, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ on {sorted(names)}, first:\n{bad[0][0]}\n{bad[0][1]}"
    return None
