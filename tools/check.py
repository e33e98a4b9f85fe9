"""Run queries against their oracles: python tools/check.py [--sf 0.01] [names or prefixes...]."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
try:
    import duckdb
except ImportError:  # a separate site folder in this container
    sys.path.append("/opt/oracle")
    import duckdb

from strandlake import get_spark  # noqa: E402
from strandlake.plans import MODULES  # noqa: E402
from strandlake.plans.fixtures import DRIVER_TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    if isinstance(v, bool):
        return str(v)
    if v is None:
        return "~"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    ap.add_argument("--cores", default="8")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    for m in [a.module] if a.module else MODULES:
        importlib.import_module(f"strandlake.plans.{m}")
    from strandlake.plans.registry import MODULE_OF, ORACLES, QUERIES

    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = get_spark("check", f"local[{a.cores}]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                      spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in list(QUERIES.items()):
        if (a.names and name not in a.names) or (a.module and MODULE_OF[name] != a.module):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:900]}", flush=True)
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s  e.g. {got[:1]}", flush=True)
            continue
        try:
            cur = con.execute(ORACLES[name])
            want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb {str(e)[:900]}", flush=True)
            continue
        t2 = time.time()
        if got == want and gcols == wcols and got:
            print(f"ok   {name}: {len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF {name}: {len(got)} vs {len(want)} cols {gcols} vs {wcols}", flush=True)
            sg, sw = set(got), set(want)
            print("   only spark:", sorted(sg - sw)[:3], "\n   only duck: ", sorted(sw - sg)[:3], flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
