"""Run a registered query on Spark and its SQL on DuckDB, and compare as the contract does."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, relation) -> str | None:
    """None when equal, else what differs."""
    left_cols, right_cols = df.columns, list(relation.columns)
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    left = canonical([tuple(r) for r in df.collect()], left_cols)
    right = canonical(relation.fetchall(), right_cols)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    kinds = dict(zip(right_cols, [str(t) for t in relation.types]))
    mismatch = [
        (c, t, kinds[c]) for c, t in df.dtypes
        if KIND.get(t.split("(")[0]) != KIND.get(kinds[c].split("(")[0].lower())
    ]
    return f"types {mismatch}" if mismatch else None


KIND = {
    "bigint": "i64", "int": "i32", "integer": "i32", "double": "f64", "string": "s", "varchar": "s",
    "boolean": "b", "hugeint": "i128", "decimal": "dec", "smallint": "i16", "tinyint": "i8",
}
