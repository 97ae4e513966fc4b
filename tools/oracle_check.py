"""Run each registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / ERROR with details.
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from churnscope.plans.registry import load_all  # noqa: E402
from churnscope.session import get_spark  # noqa: E402
from churnscope.sources.tables import DRIVER_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, int(os.environ.get("CHECK_DIGITS", "6")))
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in r))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and os.path.isdir(sys.argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not os.path.isdir(a)]
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    reg = load_all()
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.run(spark, sf_dir)
            spd = sdf.toPandas()
            st = time.time() - t0
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SPARK {name}: {str(e)[:800]}")
            bad += 1
            continue
        if q.sql is None:
            print(f"ROWS  {name}: {len(spd)} rows  cols={list(spd.columns)} {st:.1f}s")
            continue
        try:
            dpd = con.execute(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SQL {name}: {str(e)[:800]}")
            bad += 1
            continue
        sc, sr = rows_of(spd)
        dc, dr = rows_of(dpd)
        if sc != dc:
            print(f"MISMATCH-COLS {name}: spark={sc} sql={dc}")
            bad += 1
            continue
        if len(sr) != len(dr):
            print(f"MISMATCH-ROWS {name}: spark={len(sr)} sql={len(dr)}")
            bad += 1
            continue
        diffs = [(a, b) for a, b in zip(sr, dr) if a != b]
        if diffs:
            print(f"MISMATCH-VALUES {name}: {len(diffs)} rows differ; cols={sc}; first: {diffs[0]}")
            bad += 1
            continue
        types = dict(zip(spd.columns, [str(x) for x in sdf.schema]))
        dt = {c: str(t) for c, t in zip(dpd.columns, dpd.dtypes)}
        print(f"OK    {name}: {len(sr)} rows {st:.1f}s")
    print("bad:", bad)


if __name__ == "__main__":
    main()
