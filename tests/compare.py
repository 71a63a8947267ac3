"""Spark result vs DuckDB oracle: row count, column names, and an
order-insensitive comparison of values (doubles rounded)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, places: int):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, places)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item(), places)
    return v


def rows_of(rows: pa.Table, places: int) -> list[tuple]:
    """Sorted rows; from Arrow, which tells NULL from NaN."""
    out = []
    for rec in zip(*(rows.column(c).to_pylist() for c in sorted(rows.column_names)), strict=True):
        out.append(tuple(_norm(v, places) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


# Spark simple type name -> DuckDB type name
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def compare(spark_df, con, sql: str, places: int = 6) -> tuple[bool, str]:
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    rel = con.sql(sql)
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    got, want = spark_df.toArrow(), rel.to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return False, f"columns differ: {sorted(got.column_names)} vs {sorted(want.column_names)}"
    for name, t in spark_types.items():
        if TYPES.get(t, t) != duck_types.get(name):
            return False, f"type of {name}: spark {t} vs duckdb {duck_types.get(name)}"
    if got.num_rows != want.num_rows:
        return False, f"row count {got.num_rows} vs {want.num_rows}"
    a, b = rows_of(got, places), rows_of(want, places)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"first difference at sorted row {i}: {x} vs {y}"
    return True, f"{got.num_rows} rows equal"
