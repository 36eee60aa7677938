"""Run queries against their SQL in DuckDB: same columns, same rows in any order, doubles equal to 1e-5 of their size."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return None
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "item"):
        return v.item()
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None) if v.tzinfo else v
    return v


def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    rough = lambda v: (v is not None, round(v, 2) + 0.0 if isinstance(v, float) else v)
    exact = [i for i in range(len(columns)) if not any(isinstance(r[i], float) for r in rows)]
    return sorted(rows, key=lambda r: ([str(rough(r[i])) for i in exact], [str(rough(v)) for v in r]))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    for a, b in zip(_rows(left), _rows(right)):
        for x, y in zip(a, b):
            same = math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-4) if isinstance(x, (int, float)) and isinstance(y, float) or isinstance(x, float) and isinstance(y, (int, float)) else x == y
            if not same:
                return f"{a} and {b}"
    return None
