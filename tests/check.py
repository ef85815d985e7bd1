"""python tests/check.py [sf_dir] [key ...]: compare registered queries with their SQL."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, differences  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from aislewise.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sql, todo = oracle_sql(), queries()
    picked = []
    for a in args:
        picked += [k for k in todo if k == a or (a.endswith("*") and k.startswith(a[:-1]))]
        if a.startswith("plan:"):
            import importlib

            picked += list(importlib.import_module(f"aislewise.plans.{a[5:]}").REGISTRY.queries)
    picked = picked or list(todo)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf), 0
    for key in picked:
        t0 = time.time()
        try:
            got = todo[key](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: {str(e)[:600]}")
            bad += 1
            continue
        t1 = time.time()
        if key not in sql:
            print(f"rows {key}: {len(got)} ({t1 - t0:.1f}s)")
            continue
        try:
            want = con.execute(sql[key]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key} (sql): {str(e)[:600]}")
            bad += 1
            continue
        t2 = time.time()
        diff = differences(got, want)
        print(f"{'ok  ' if not diff else 'DIFF'} {key}: {len(got)} rows ({t1 - t0:.1f}s, sql {t2 - t1:.1f}s)")
        for d in diff:
            print("     ", d)
        bad += bool(diff)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
