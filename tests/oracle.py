"""Comparison with DuckDB, used by the query tests."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def text(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "NULL"
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v)[:19]
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(int(v)) < 10**6 else str(int(v))
    return str(v)


def rows(df: pd.DataFrame, ints: list[str] = ()) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)].astype(object)
    out = []
    for r in df.itertuples(index=False, name=None):
        out.append(tuple(text(int(v)) if c in ints and text(v) != "NULL" else text(v) for c, v in zip(df.columns, r)))
    return sorted(out)
