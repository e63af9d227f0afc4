"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Folders of stored intermediate tables.
_staged: list[str] = []
#: Applications whose Python workers have the package.
_shipped: set[str] = set()


def build_session(master: str | None = None, app: str = "reviewlake", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    generously: adaptive execution merges small partitions but cannot split a
    shuffle that was declared too narrow.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    without it is an error, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="reviewlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, which :func:`drop_staged` removes."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    _staged.append(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the package's sources to the Python workers, once for each application.

    An operator that runs Python on the workers calls this first: executors do not have the
    driver's import path. The sources are packed in the shared checkpoint folder, which stays as
    long as the application does.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    path = f"{ensure_checkpoint_dir(spark)}/package-{uuid4().hex}/reviewlake-sources.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def persist_reliably(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    The result survives lost executors. Unlike ``checkpoint()`` it is columnar, so
    later steps read only the columns they use, and its size on disk tells the
    optimiser whether it is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that :func:`persist_reliably` has stored; returns their number.

    Call it between jobs, when no frame that reads them is used any more.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _staged:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        dropped += path.getFileSystem(conf).delete(path, True)
    return dropped


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting the rows of an already stored frame.

    Beyond ``max_rows`` the frame is returned unhinted and the join shuffles.
    The count stops at ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
