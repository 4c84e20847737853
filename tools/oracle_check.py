"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema (sorted names) and value match.
"""
from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is pd.NA:
        return None
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name:28s} rows={len(s):7d} spark={t1 - t0:5.1f}s  (no oracle)"
    o = con.execute(sql).df()
    same_cols = sorted(s.columns) == sorted(o.columns)
    ok_rows = len(s) == len(o)
    ok_vals = same_cols and ok_rows and canon(s) == canon(o)
    msg = "OK " if ok_vals else "BAD"
    detail = ""
    if not same_cols:
        detail = f" cols spark={sorted(s.columns)} oracle={sorted(o.columns)}"
    elif not ok_vals:
        cs, co = canon(s), canon(o)
        diff = [(a, b) for a, b in zip(cs, co) if a != b][:2]
        detail = f" first diffs={diff}"
    return f"{msg} {name:28s} rows={len(s):7d}/{len(o):7d} spark={t1 - t0:5.1f}s{detail}"


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from apptflow.plans.registry import REGISTRY, _load_all
    from apptflow.session import get_session
    _load_all()
    spark = get_session()
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        sqltext = sql() if callable(sql) else sql
        try:
            line = compare(spark, con, name, fn, sqltext, sf_dir)
        except Exception as exc:  # report and continue
            line = f"ERR {name:28s} {type(exc).__name__}: {str(exc)[:400]}"
        if not line.startswith("OK") and "(no oracle)" not in line:
            bad += 1
        print(line, flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
