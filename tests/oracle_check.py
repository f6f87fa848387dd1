"""Run every registered query on Spark and its oracle SQL on DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: row count, sorted column names, and the multiset of rows with
floats rounded to 9 significant digits (the driver hashes values; this is a
slightly more tolerant local stand-in that still catches real mismatches).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    import duckdb
    import __spark_entry__ as E
    from kiln.session import build_session
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oracle = E.queries(), E.oracle_sql()
    ok = bad = rows_only = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s) [no oracle]")
            rows_only += 1
            continue
        try:
            cur = con.execute(oracle[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {name}: columns spark={sorted(scols)} oracle={sorted(ocols)}")
            bad += 1
            continue
        a, b = canon(srows, scols), canon(orows, ocols)
        if len(a) != len(b):
            print(f"FAIL {name}: rows spark={len(a)} oracle={len(b)}")
            bad += 1
            continue
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: values differ, e.g. {diffs}")
            bad += 1
            continue
        print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
        ok += 1
    print(f"\nsummary: ok={ok} fail={bad} rows_only={rows_only}")
    return 0 if bad == 0 else 1


if __name__ == "__main__":
    raise SystemExit(main())
