"""Compare all (or the named) queries with DuckDB: ``python tests/run_compare.py SF_DIR [name...]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entry_points  # noqa: E402
from compare import compare, duck  # noqa: E402

from reviewlake.session import build_session  # noqa: E402

sf_dir, names = sys.argv[1], sys.argv[2:]
spark = build_session(
    "local[8]",
    **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf_dir)
bad = 0
for name in names or entry_points.queries():
    start = time.time()
    try:
        if name in entry_points.oracle_sql():
            problem = compare(spark, con, sf_dir, name)
        else:
            problem = f"(rows only: {entry_points.queries()[name](spark, sf_dir).count()})"
    except Exception as error:  # report and go on with the next query
        problem = f"{type(error).__name__}: {str(error)[:700]}"
    bad += bool(problem) and not problem.startswith("(")
    print(f"{'ok ' if not problem else '!! '}{name} {time.time() - start:.1f}s {problem}", flush=True)
print("differences:", bad)
