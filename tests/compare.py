"""The driver's comparison: row count, columns and an order-free hash of values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        target = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{target}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [[plain(v) for v in table[n].to_pylist()] for n in names]
    return sorted(zip(*cols), key=repr) if cols else []


def difference(spark_table, duck_table) -> str:
    """Empty if both results are equal."""
    a, b = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if a != b:
        return f"columns {a} and {b}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} and {duck_table.num_rows}"
    types = {n: (str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type)) for n in a}
    x, y = rows_of(spark_table), rows_of(duck_table)
    for p, q in zip(x, y):
        if p != q:
            return f"{str(p)[:300]} and {str(q)[:300]} ({types})"
    return ""
