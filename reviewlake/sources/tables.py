"""Scans: S1-S6 and S10. Pruning and pushdown are left to the optimiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reviewlake.schemas import normalize_columns
from reviewlake.sources.csv_records import parsed_csv


def scan(
    spark: SparkSession,
    source: str,
    columns: list[str] | None = None,
    limit: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A path (contains ``/``) or a table name. Read errors are raised."""
    df = spark.read.format(fmt).load(source) if "/" in source else spark.read.table(source)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def spread_small_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Give per-row text work all the cores when the scan has fewer splits than that.

    A small table in one file is one task however many cores there are. A table
    with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """S3: a chunked database scan; each chunk is one task's range of the key.

    ``lower`` and ``upper`` only shape the ranges: rows outside fall into the
    first and last chunk, none are lost.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        fetchsize=options.pop("fetchsize", "10000"),
        **options,
    )
    return reader.load()


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header row, explicit schema, review texts that span lines; snake_case names.

    A file is read by as many tasks as it has splits, whatever its values hold.
    """
    return normalize_columns(parsed_csv(spark, path, schema))


def scan_links(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """The work queue, with its ``Link``/``Name`` columns in snake_case."""
    return normalize_columns(scan(spark, source, fmt=fmt))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def describe_columns(df: DataFrame, generated: tuple[str, ...] = ("id",)) -> DataFrame:
    """(ordinal, name, type, nullable, display_type), one row per column.

    Columns listed in ``generated`` are shown as ``SERIAL``.
    """
    rows = [
        (
            i,
            f.name,
            f.dataType.simpleString(),
            f.nullable,
            "SERIAL" if f.name in generated else f.dataType.simpleString().upper(),
        )
        for i, f in enumerate(df.schema, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, name string, type string, nullable boolean, display_type string"
    )
