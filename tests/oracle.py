"""Comparison of a Spark query with its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(data=DATA):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(_plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False))
