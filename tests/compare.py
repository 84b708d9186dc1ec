"""Run a query in Spark and its SQL in DuckDB and compare names, types and rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0  # -0.0 becomes 0.0
    return v


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty when schema and all rows are the same."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    left = df.select(*[f"`{n}`" for n in names]).collect()
    rel = con.sql(sql)
    found = []
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(theirs) != names:
        return [f"columns {names} against {sorted(theirs)}"]
    for n in names:
        if TYPES.get(types[n], types[n]) != theirs[n]:
            found.append(f"type of {n}: {types[n]} against {theirs[n]}")
    order = [rel.columns.index(n) for n in names]
    right = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    left = sorted((tuple(_plain(v) for v in r) for r in left), key=_key)
    if len(left) != len(right):
        found.append(f"{len(left)} rows against {len(right)}")
    for a, b in zip(left, right):
        if a != b:
            found.append(f"row {a} against {b}")
            break
    return found
