"""Run catalogue queries on Spark and DuckDB and compare (row count, columns, values)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

SF_SMALL = "/root/testdata/sf0.001"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(type(x).__name__), x) if not isinstance(x, (int, float))
                 else (1, "n", float(x)) for x in row)


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    sp = spark_df.toPandas()
    dk = con.execute(sql).fetchdf()
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    cols = sorted(sp.columns)
    a = sorted([tuple(_norm(x) for x in r) for r in sp[cols].itertuples(index=False)], key=_key)
    b = sorted([tuple(_norm(x) for x in r) for r in dk[cols].itertuples(index=False)], key=_key)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        for cx, cy, name in zip(x, y, cols):
            if cx is None and cy is None:
                continue
            if isinstance(cx, (int, float)) and isinstance(cy, (int, float)) and cx is not None and cy is not None:
                if abs(float(cx) - float(cy)) > 1e-6 * max(1.0, abs(float(cy))):
                    return False, f"value differs in {name}: {x} vs {y}"
            elif str(cx) != str(cy):
                return False, f"value differs in {name}: {cx!r} vs {cy!r}"
    exact = a == b
    return True, f"{len(a)} rows" + ("" if exact else " (equal within 1e-6, not bit-exact)")
