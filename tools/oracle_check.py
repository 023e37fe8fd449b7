"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]

Comparison: same column names, same row count, and the same multiset of rows
after rounding floats to 6 digits (order-insensitive).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetcat.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from fleetcat.session import DRIVER_TABLES, build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, sf_dir)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLES:
            print(f"ROWS  {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[n])
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: duckdb error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(dcols) != scols:
            print(f"FAIL  {n}: columns spark={scols} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(srows, scols), rows_of(drows, scols)
        if a == b:
            print(f"OK    {n}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL  {n}: rows spark={len(a)} duck={len(b)}")
            for r in list(sa - sb)[:3]:
                print("   spark-only", r)
            for r in list(sb - sa)[:3]:
                print("   duck-only ", r)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
