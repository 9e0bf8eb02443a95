"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0  # -0.0
    return value


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both agree in columns, types of values, row count and values."""
    rows = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    mine, theirs = normal(spark_df.columns, rows), normal(names, expected)
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {[type(x) for x in a]} != {[type(x) for x in b]}"
    return None
