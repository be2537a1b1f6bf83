"""Run registered queries with Spark and their oracle SQL with DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
Prints one line per query: name, rows (spark/duckdb), match flag.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402


def normalize(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if isinstance(v, (np.floating,)):
        return normalize(float(v))
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(normalize(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normalize(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def frame_rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(normalize(x) for x in rec))
    return cols, sorted(rows, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from shardwise.plans.catalog import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from shardwise.session import get_session
    import __spark_entry__ as E

    spark = get_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as exc:  # report and go on
            print(f"{name:28s} SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:28s} spark={len(sdf):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            ddf = con.execute(sql[name]).df()
        except Exception as exc:
            print(f"{name:28s} DUCKDB ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        scols, srows = frame_rows(sdf)
        dcols, drows = frame_rows(ddf)
        ok = scols == dcols and srows == drows
        bad += not ok
        msg = "" if ok else (f" cols {scols} vs {dcols}" if scols != dcols else "")
        if not ok and scols == dcols:
            diff = [(a, b) for a, b in zip(srows, drows) if a != b][:2]
            msg = f" first diffs: {diff}"
        print(f"{name:28s} spark={len(sdf):7d} duck={len(ddf):7d} {'OK ' if ok else 'BAD'} {ts:.1f}s{msg}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
