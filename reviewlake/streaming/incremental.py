"""New bronze files -> cleaned rows -> append of the unseen ones, as a stream.

Cleaning is stateless per row, so the stream keeps no state; duplicates are found
against the stored table by the same grouping as in the batch job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reviewlake.plans.cleaning import clean_columns
from reviewlake.schemas import GOLD_KEYS
from reviewlake.sources.sinks import append_new


def bronze_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files as they arrive; a batch takes at most ``files_per_batch`` of them,
    the rest wait for the next batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = GOLD_KEYS,
    order: str = "id",
    transform: Callable[[DataFrame], DataFrame] = clean_columns,
    trigger: dict | None = None,
) -> StreamingQuery:
    """K6 per micro-batch. A batch that is replayed after a failure adds nothing twice,
    because its rows are then already in the table."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(transform(batch), path, keys, order, null_safe=True)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
