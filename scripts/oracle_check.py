"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive hash of the values.

usage: python scripts/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from murmur.plans.catalog import ORACLE, QUERIES  # noqa: E402
from murmur.session import get_spark  # noqa: E402
from murmur.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"{name:28s} ERR {str(exc).splitlines()[0][:300]}")
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"{name:28s} rows-only  spark={len(srows)} ({ts:.1f}s)")
            continue
        t0 = time.time()
        try:
            cur = con.execute(ORACLE[name])
        except Exception as exc:
            bad += 1
            print(f"{name:28s} SQL-ERR {str(exc).splitlines()[0][:300]}")
            continue
        dcols = [d[0] for d in cur.description]
        drows = cur.fetchall()
        td = time.time() - t0
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} "
              f"({ts:.1f}s / {td:.1f}s)" + ("" if sorted(scols) == sorted(dcols)
                                            else f" cols {sorted(scols)} vs {sorted(dcols)}"))
        if not ok and sorted(scols) == sorted(dcols):
            a, b = set(ls), set(ld)
            for x in list(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in list(b - a)[:3]:
                print("   duck  only:", x[:300])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
