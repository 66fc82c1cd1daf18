"""Compare named jobs (all by default) with their SQL: python tests/check.py [sf] [key ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import make_session  # noqa: E402
from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    path = f"/root/testdata/{sf}"
    spark = make_session()
    con = connect(path)
    qs, sqls = entry.queries(), entry.oracle_sql()
    keys = [k for k in qs if not args or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]
    failed = []
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, path)
            if k in sqls:
                issues = compare(df, con, sqls[k])
                note = "sql"
            else:
                rows = df.collect()
                issues = [] if rows else ["no rows"]
                note = f"rows={len(rows)} {rows[:3] if args else ''}"
        except Exception as e:  # noqa: BLE001
            issues = [f"{type(e).__name__}: {str(e)[:600]}"]
            if args:
                traceback.print_exc(limit=-4)
            note = ""
        print(f"{'ok  ' if not issues else 'FAIL'} {time.time() - t0:6.2f}s {k} {note}", flush=True)
        for i in issues:
            print("       ", i, flush=True)
        if issues:
            failed.append(k)
    print(f"{len(keys) - len(failed)} of {len(keys)} ok; failed: {failed}")
