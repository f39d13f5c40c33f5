"""Compare all registered queries with their SQL: run_oracle.py SF_DIR [NAME ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from gridledger.session import build_session
from tests import oracle


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        begin = time.time()
        try:
            if name in sql:
                ok, note = oracle.compare(queries[name](spark, sf_dir), con, sql[name])
            else:
                ok, note = True, f"rows only {queries[name](spark, sf_dir).count()}"
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.1f}s {note}"[:1200], flush=True)
    print(f"{failed} failed of {len(names or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
