"""Run every registered query (or those named) against its oracle: python tests/check_all.py [sf] [names...]"""

import sys
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(cpus=8), connect(sf)
    oracles, bad = oracle_sql(), 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and not any(part in name for part in sys.argv[2:]):
            continue
        try:
            problem, rows, took = compare(spark, con, sf, run, oracles.get(name))
        except Exception as error:  # report and go on
            problem, rows, took = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:36s} {kind:6s} rows={rows:<7d} {took:6.2f}s {problem or ''}"[:1500], flush=True)
    print("failed:", bad)


main()
