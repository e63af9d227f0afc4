"""Time queries on their own: ``python tests/time_queries.py SF_DIR [name...]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent)]

import __spark_entry__ as entry_points  # noqa: E402

from reviewlake.session import build_session  # noqa: E402

sf_dir, names = sys.argv[1], sys.argv[2:]
spark = build_session(
    "local[8]",
    **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
)
spark.sparkContext.setLogLevel("ERROR")
for name in names or entry_points.queries():
    times = []
    for _ in range(3):
        start = time.time()
        entry_points.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.time() - start)
    print(f"{name} " + " ".join(f"{t:.2f}" for t in times), flush=True)
