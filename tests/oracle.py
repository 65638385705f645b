"""Compare a Spark query with its SQL oracle, row for row."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _kind(dtype) -> str:
    if pd.api.types.is_bool_dtype(dtype):
        return "bool"
    if pd.api.types.is_integer_dtype(dtype):
        return "int"
    if pd.api.types.is_float_dtype(dtype):
        return "float"
    if pd.api.types.is_datetime64_any_dtype(dtype):
        return "time"
    return "object"


def _text(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA:
        return "null"
    if isinstance(value, (float, np.floating)):
        return "null" if np.isnan(value) else repr(float(value))
    if isinstance(value, (np.bool_, bool)):
        return str(bool(value))
    if isinstance(value, (np.integer, int)):
        return str(int(value))
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(zip(*[[_text(v) for v in df[c]] for c in columns]))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    for c in got.columns:
        if (_kind(got[c].dtype) != _kind(want[c].dtype)
                and not got[c].isna().any() and not want[c].isna().any()):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None
