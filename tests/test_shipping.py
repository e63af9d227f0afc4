"""Python workers find the package wherever a job is started."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

JOB = """
import sys
sys.path.insert(0, {repo!r})
from reviewlake.catalog import QUERIES
from reviewlake.session import build_session
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {ckpt!r}}})
for name in ("page_nested_text", "page_nested_fields", "bronze_from_pages", "embedding_top_phrases", "csv_round_trip"):
    rows = QUERIES[name](spark, {sf!r})
    rows.write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


def test_jobs_run_from_a_foreign_folder(tmp_path, sf_dir):
    job = tmp_path / "job.py"
    job.write_text(JOB.format(repo=str(REPO), ckpt=str(tmp_path / "ckpt"), sf=sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # Workers start in the folder of the job, from which the package cannot be imported.
    done = subprocess.run([sys.executable, "-P", str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ran ") == 5, done.stdout + done.stderr[-3000:]
