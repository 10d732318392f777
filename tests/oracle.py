"""Comparison of a query with its SQL."""

from __future__ import annotations

from numbers import Integral
from pathlib import Path

import duckdb
import pandas as pd


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(directory).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def kind(name: str) -> str:
    """The family of a type of either engine; integers and floating numbers are different ones."""
    low = name.lower()
    for family, starts in (("whole", ("int", "bigint", "long", "smallint", "tinyint", "hugeint", "ubigint", "uinteger")), ("floating", ("double", "float", "decimal")), ("text", ("string", "varchar")), ("truth", ("bool",)), ("time", ("timestamp",))):
        if low.startswith(starts):
            return family
    return low


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if pd.isna(v):
            return "<null>"
        whole = isinstance(v, Integral) and not isinstance(v, bool)
        return f"{v:.6f}" if isinstance(v, float) or (whole and abs(v) < 2**53) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))
