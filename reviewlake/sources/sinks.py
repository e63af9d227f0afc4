"""Sinks: K1-K6, K8-K11. A failed write fails the job; nothing is swallowed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from reviewlake.functions.arrays import array_literal
from reviewlake.operators.dedup import dedup_rows, new_rows, relevant_keys
from reviewlake.operators.metrics import reconcile
from reviewlake.schemas import GOLD_KEYS, conform, missing_columns
from reviewlake.session import persist_reliably


#: Partitions that rows are dealt to before adaptive execution merges and cuts them.
PARTITIONS_PER_VALUE = 4
MAX_REBALANCE_PARTITIONS = 20_000
#: A batch of up to so many keys a bucket names them to the scan, which then skips the other
#: buckets; with more keys hardly a bucket could be skipped.
PRUNING_KEYS_PER_BUCKET = 2
KEY_DIGEST = "key_digest"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def create_if_absent(spark: SparkSession, path: str, schema: StructType) -> bool:
    """K1: an empty typed table where there is none; an existing one must fit the schema."""
    if path_exists(spark, path):
        absent = missing_columns(spark.read.parquet(path), schema)
        if absent:
            raise ValueError(f"{path} lacks columns {absent}")
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def overwrite(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    max_records_per_file: int = 5_000_000,
) -> None:
    """Replace a table; every partition is written by its own task.

    ``partition_by`` gives a folder per value, which prunes reads the way a secondary index would.
    Rows are brought together by value first (see :func:`rebalanced`), so a folder has as many
    files as its size asks for and not one from each task. ``sort_by`` orders rows within each file,
    for row-group skipping.

    The new table is written beside the old one and renamed over it when it is whole: a
    job that fails leaves the old table as it was, and the source may read from ``path``.
    """
    if partition_by:
        df = rebalanced(df, partition_by)
    if partition_by or sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    fresh = f"{path.rstrip('/')}__next-{uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", max_records_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    swap(df.sparkSession, fresh, path)


def rebalanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K5: rows dealt by value to tasks of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.

    Adaptive execution merges small partitions and cuts those that a value with many rows makes
    too large, by the sizes it has measured: a value that holds a third of the rows gets a third
    of the tasks. Dealing starts from several partitions a value, so that values seldom share one
    that is cut. The files are about size / advisory size + values.
    """
    spark = df.sparkSession
    values = df.agg(F.approx_count_distinct(F.struct(*columns))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("rebalance", min(max(PARTITIONS_PER_VALUE * values, least), MAX_REBALANCE_PARTITIONS), *columns)


def swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in the place of ``path``; the old one goes last."""
    fs, target = _file_system(spark, path)
    source = _file_system(spark, fresh)[1]
    old = _file_system(spark, f"{path.rstrip('/')}__old-{uuid4().hex}")[1]
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if replaced:
            fs.rename(old, target)
        raise OSError(f"cannot move {fresh} to {path}")
    if replaced:
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def overwrite_known(df: DataFrame, path: str, schema: StructType) -> None:
    """K4: keep the layer's columns, in order and typed, and replace the table."""
    overwrite(conform(df, schema), path)


def append(df: DataFrame, path: str) -> None:
    """K3: add rows; an empty frame adds none."""
    df.write.mode("append").parquet(path)


def append_new(
    batch: DataFrame,
    path: str,
    keys: Sequence[str] = GOLD_KEYS,
    order: str = "id",
    null_safe: bool = True,
) -> DataFrame:
    """K6, K8: append the unseen rows and return the reconciliation counts.

    The rows to add are stored beside the table first. They are computed once,
    the counts do not see rows of their own run, and a retry of the append does
    not compare against half of itself. ``batch`` is read twice, so it should be a
    stored table.
    """
    spark = batch.sparkSession
    target = spark.read.parquet(path)
    staged_path = f"{path.rstrip('/')}__staged"
    known = relevant_keys(target, batch, keys)
    new_rows(batch, known, keys, order, null_safe).write.mode("overwrite").parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    before = target.agg(F.count("*").alias("n")).first()["n"]
    append(staged.select(*target.columns), path)
    spark.catalog.refreshByPath(path)
    counts = reconcile(target.limit(0), spark.read.parquet(path), staged)
    inserted = F.col("after") - F.lit(before)
    return counts.select(
        F.lit(before).cast("long").alias("before"),
        "after",
        inserted.alias("inserted"),
        "expected",
        (inserted == F.col("expected")).alias("ok"),
    )


def _digest(keys: Sequence[str]):
    return F.xxhash64(*[p for k in keys for p in (F.col(k).isNull(), F.col(k))])


def create_bucketed(
    spark: SparkSession, name: str, schema: StructType, keys: Sequence[str] = GOLD_KEYS, buckets: int = 200, path: str | None = None
) -> bool:
    """K1, K6: an empty table whose rows lie in buckets by a digest of their key, and sorted by it.

    A NULL counts as a value. Size ``buckets`` so that one is worth a task, say 1 GB: their number
    stays when the table grows.
    """
    if spark.catalog.tableExists(name):
        absent = missing_columns(spark.read.table(name), schema)
        if absent:
            raise ValueError(f"{name} lacks columns {absent}")
        return False
    empty = spark.createDataFrame([], schema).withColumn(KEY_DIGEST, _digest(keys))
    writer = empty.write.bucketBy(buckets, KEY_DIGEST).sortBy(KEY_DIGEST)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return True


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    if rows is None:
        raise ValueError(f"{name} has no buckets")
    return int(rows["data_type"])


def unseen_in_bucketed(batch: DataFrame, name: str, keys: Sequence[str] = GOLD_KEYS, order: str = "id") -> DataFrame:
    """J1 against a table of :func:`create_bucketed`: the batch's first row of each key it lacks.

    Only the batch is shuffled, to the table's buckets; the table is joined where it lies. A batch of
    few keys (``PRUNING_KEYS_PER_BUCKET``) reads only the buckets of those keys, and within them the
    row groups whose range of digests can hold one. Keys are compared in full, NULL equals NULL.
    """
    spark = batch.sparkSession
    buckets = _buckets(spark, name)
    fresh = dedup_rows(batch, keys, order).withColumn(KEY_DIGEST, _digest(keys))
    most = PRUNING_KEYS_PER_BUCKET * buckets
    wanted = [r[0] for r in batch.select(_digest(keys)).distinct().limit(most + 1).collect()]
    known = spark.read.table(name).select(KEY_DIGEST, *(F.col(k).alias(f"_known_{i}") for i, k in enumerate(keys)))
    if len(wanted) <= most:
        known = known.where(f"{KEY_DIGEST} IN ({', '.join(f'{w}L' for w in wanted)})" if wanted else "false")
    dealt = fresh.repartition(buckets, KEY_DIGEST).alias("b")
    same = F.col(f"b.{KEY_DIGEST}") == F.col(f"t.{KEY_DIGEST}")
    for i, k in enumerate(keys):
        ours, theirs = F.col(f"b.{k}"), F.col(f"t._known_{i}")
        # Not ``<=>``, which would become a key of the join, and the table's buckets would not serve it.
        same = same & F.coalesce(ours == theirs, ours.isNull() & theirs.isNull())
    return dealt.join(known.hint("merge").alias("t"), same, "left_anti")


def append_new_bucketed(batch: DataFrame, name: str, keys: Sequence[str] = GOLD_KEYS, order: str = "id") -> DataFrame:
    """K6, K8: append the unseen rows to a table of :func:`create_bucketed`; returns the added rows.

    The rows to add are stored first, so a retry of the append does not compare against half of
    itself, and their files are sorted and one for each bucket they touch.
    """
    spark = batch.sparkSession
    buckets = _buckets(spark, name)
    target = spark.read.table(name)
    added = persist_reliably(unseen_in_bucketed(batch, name, keys, order).select(*target.columns))
    dealt = added.repartition(buckets, KEY_DIGEST)
    dealt.write.mode("append").bucketBy(buckets, KEY_DIGEST).sortBy(KEY_DIGEST).saveAsTable(name)
    return added.drop(KEY_DIGEST)


def with_generated(df: DataFrame, keys: Sequence[str] = GOLD_KEYS, order: str | None = None) -> DataFrame:
    """A key that is the same on every run, and the load time.

    A NULL counts as a value of its own. Rows with a NULL key column can be stored several
    times, so ``order``, if given, is part of their key.
    """
    parts = [p for k in keys for p in (F.col(k).isNull(), F.col(k))]
    if order is not None:
        no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        parts.append(F.when(no_key, F.col(order)))
    return df.withColumn("id", F.xxhash64(*parts)).withColumn("inserted_at", F.current_timestamp())


def export_csv(df: DataFrame, path: str) -> None:
    """K9: header row; lists in their ``{"a","b"}`` text form."""
    columns = [
        array_literal(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
        for f in df.schema
    ]
    writer = df.select(*columns).write.mode("overwrite").option("header", True)
    writer.option("escape", '"').csv(path)
