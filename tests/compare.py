"""Compare a Spark query with its SQL in DuckDB, regardless of row order."""

import os

import duckdb
import pandas as pd


def connect(data: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        path = f"{data}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        t = pd.Timestamp(x)
        return (t.tz_convert("UTC").tz_localize(None) if t.tz is not None else t).isoformat()
    return float(f"{float(x):.9g}") if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else x


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
