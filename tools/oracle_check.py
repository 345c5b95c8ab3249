"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.plans.registry import all_entries  # noqa: E402
from quarry.session import get_spark  # noqa: E402
from quarry.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "as_py"):
        v = v.as_py()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    keys = [a for a in args if not os.path.isdir(a)]
    spark = get_spark()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    ents = all_entries()
    bad = 0
    for k, e in ents.items():
        if keys and k not in keys:
            continue
        t0 = time.time()
        try:
            df = e.build(spark, sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {k}: spark error {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.oracle is None:
            print(f"rows {k}: {len(s_rows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(e.oracle)
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(ex)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL {k}: columns {sorted(s_cols)} vs {sorted(d_cols)}")
            bad += 1
            continue
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            bad += 1
            print(f"FAIL {k}: {len(a)} vs {len(b)} rows")
            sa, sb = set(a), set(b)
            print("   spark-only", list(sa - sb)[:3])
            print("   duck-only ", list(sb - sa)[:3])
        else:
            print(f"ok   {k}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
