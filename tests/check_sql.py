"""Command line: compare all or some registered queries with their SQL.

python tests/check_sql.py [sf] [name-part ...]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from duck import compare, connect  # noqa: E402
from loanweave.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                text = compare(df, con, sqls[name])
            else:
                text = "" if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(text)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if text else 'ok'} {name} [{kind}] {time.time() - t:.1f}s {text[:1500]}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
