"""Run registered queries against their SQL: python tests/check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from factorloom.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark, con = local_session(8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("entry", entry.entry(spark).collect())
    unknown = set(sql) - set(queries)
    failed = len(unknown)
    if unknown:
        print("sql without query", unknown)
    for name, run in queries.items():
        if names and name not in names:
            continue
        begun = time.time()
        try:
            if name in sql:
                problem = differences(run(spark, folder), con, sql[name])
            else:
                rows = run(spark, folder).collect()
                problem = None if rows else "no rows"
                print("   rows only:", len(rows), rows[:2])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:30s} {time.time() - begun:6.2f}s {problem or 'ok'}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    chosen = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(chosen, sys.argv[2:])))
