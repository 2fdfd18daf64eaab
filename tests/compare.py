"""Compare a Spark result with an SQL result, cell by cell, in any row order."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    picked = [tuple(plain(row[n]) for n in order) for row in rows]
    return [columns[n] for n in order], sorted(picked, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def difference(spark_df, con, sql) -> str | None:
    """A description of the first difference, or None when the results are equal."""
    left_columns, left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_columns, right = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right, strict=True):
        for name, x, y in zip(left_columns, a, b, strict=True):
            if x != y or type(x) is not type(y):
                return f"{name}: {x!r} != {y!r} in {a!r} / {b!r}"
    return None
