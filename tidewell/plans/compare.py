"""Runs a registered query and its DuckDB text on the same tables and compares their rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x) -> object:
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, list | tuple):
        return tuple(cell(y) for y in x)
    if hasattr(x, "tolist"):
        return cell(x.tolist())
    return x


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def differences(spark_df, con, sql: str) -> str | None:
    """None where rows and columns are the same, else what differs first."""
    got_names = spark_df.columns
    got = rows_of(got_names, spark_df.collect())
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = rows_of(want_names, cursor.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; e.g. {got[:2]} and {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
