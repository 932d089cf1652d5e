"""Comparison of a Spark result with its SQL twin, by values whatever the order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 7)
    if hasattr(x, "is_finite"):
        return round(float(x), 7)
    return x


def rows(columns, data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, duck) -> str:
    """Empty if equal, else what differs."""
    rel = duck.sql(sql)
    names, want = rel.columns, rel.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} and {len(b)} rows; first difference {first}"
