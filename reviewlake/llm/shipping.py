"""Prepare a running session: the package in its Python workers, and batches bounded by bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from reviewlake.session import ship_package

#: Ten thousand long texts would not fit in a worker; a batch ends at this size as well.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_session(spark: SparkSession) -> None:
    """Give the workers the package and bound the batches they get.

    The bound holds for the session from then on; a batch size that the session sets itself is kept.
    """
    if spark.conf.get(_BATCH_SETTING, None) in (None, str(2**31 - 1), "-1"):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    ship_package(spark)
