"""Compare a registered Spark query with its DuckDB oracle SQL on parquet tables
(row count, column names, order-insensitive row multiset)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

from ..sources.tables import TABLE_NAMES


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item") and not isinstance(v, (dt.date, dt.datetime)):
        return v.item()
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """Returns (ok, message)."""
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    if sql is None:
        return True, f"{len(srows)} rows (no oracle)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ spark={scols} duck={dcols}"
    sk, dk = rows_key(scols, srows), rows_key(dcols, drows)
    if sk != dk:
        sset, dset = set(map(repr, sk)), set(map(repr, dk))
        so = [r for r in sk if repr(r) not in dset][:3]
        do = [r for r in dk if repr(r) not in sset][:3]
        return False, f"rows spark={len(sk)} duck={len(dk)}; spark-only {so}; duck-only {do}"
    return True, f"{len(sk)} rows"
