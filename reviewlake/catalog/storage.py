"""Written to the staging folder and read back."""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import functions as F

from reviewlake.catalog.registry import query, table
from reviewlake.schemas import conform, normalize_columns
from reviewlake.session import scratch_path
from reviewlake.sources import sinks, tables

#: Texts that one task writes to one file: some splits of a scan.
ONE_FILE_BYTES = 1 << 29

_DOCS = "doc_id, text, lang, source, n_chars"


def _path(spark, name: str) -> str:
    return scratch_path(spark, name)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*_DOCS.split(", "))


@query("create_then_append", f"SELECT {_DOCS}, TRUE AS created, FALSE AS created_again FROM documents")
def create_then_append(spark, sf_dir):
    """K1, K3: an empty typed table, found again, then filled in two appends."""
    docs, path = _documents(spark, sf_dir), _path(spark, "created")
    created = sinks.create_if_absent(spark, path, docs.schema)
    again = sinks.create_if_absent(spark, path, docs.schema)
    sinks.append(docs.where("doc_id % 2 = 0"), path)
    sinks.append(docs.where("doc_id IS NULL OR doc_id % 2 != 0"), path)
    return spark.read.parquet(path).withColumns({"created": F.lit(created), "created_again": F.lit(again)})


@query("overwrite_partitioned", f"SELECT {_DOCS} FROM documents WHERE lang IN ('fr', 'es')")
def overwrite_partitioned(spark, sf_dir):
    """Replaced by a table with a folder per language, read by folder."""
    docs, path = _documents(spark, sf_dir), _path(spark, "partitioned")
    sinks.overwrite(docs.limit(0), path)
    sinks.overwrite(docs, path, partition_by=["lang"], sort_by=["doc_id"])
    return spark.read.parquet(path).where(F.col("lang").isin("fr", "es")).select(*docs.columns)


@query(
    "overwrite_skewed",
    """SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS n_chars FROM (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END AS source, n_chars FROM documents) GROUP BY source""",
)
def overwrite_skewed(spark, sf_dir):
    """K5: a folder per source, of which one has a third of all rows, cut by adaptive execution."""
    docs, path = _documents(spark, sf_dir), _path(spark, "skewed")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    sinks.overwrite(hot, path, partition_by=["source"])
    stored = spark.read.parquet(path).groupBy("source")
    return stored.agg(F.count("*").alias("rows"), F.sum("n_chars").alias("n_chars"))


@query(
    "overwrite_from_itself",
    "SELECT doc_id, lang, NULL::BIGINT AS n_chars FROM documents WHERE lang <> 'en'",
)
def overwrite_from_itself(spark, sf_dir):
    """K4: a layer's known columns replace the table that they were read from."""
    docs, path = _documents(spark, sf_dir).select("doc_id", "lang"), _path(spark, "swapped")
    sinks.overwrite(docs.withColumn("extra", F.lit(1)), path)
    kept = spark.read.parquet(path).where("lang != 'en'")
    schema = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").schema
    sinks.overwrite_known(kept, path, schema)
    return spark.read.parquet(path)


@query(
    "csv_round_trip",
    """SELECT doc_id, text, '{"' || lang || '","' || source || '"}' AS both_names FROM documents""",
)
def csv_round_trip(spark, sf_dir):
    """Exported with a list column and line breaks in texts, and scanned again."""
    docs, path = _documents(spark, sf_dir), _path(spark, "csv")
    listed = docs.select(F.col("doc_id").alias("Doc Id"), "text", F.array("lang", "source").alias("Both Names"))
    sinks.export_csv(listed, path)
    return tables.scan_csv(spark, path, "`Doc Id` long, text string, `Both Names` string")


@query(
    "csv_scan_one_file",
    r"""SELECT doc_id, replace(text, '.', '."' || chr(10) || '",') AS text, lang FROM documents""",
)
def csv_scan_one_file(spark, sf_dir):
    """One file of all texts, with quotes, commas and line breaks in them, read by all tasks.

    Each file is written by one task, so texts beyond ``ONE_FILE_BYTES`` go on in another file.
    """
    broken = F.replace("text", F.lit("."), F.lit('."\n",'))
    path = _path(spark, "one-csv")
    docs = _documents(spark, sf_dir).select("doc_id", broken.alias("text"), "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = math.ceil(size / ONE_FILE_BYTES)
    sinks.export_csv(docs.coalesce(1) if files <= 1 else docs.repartition(files), path)
    return tables.scan_csv(spark, path, "doc_id long, text string, lang string")


@query(
    "generated_keys",
    """SELECT count(*) AS rows, count(DISTINCT (source, lang)) FILTER (lang IS NOT NULL) + count(*) FILTER (lang IS NULL) AS keys,
  0::BIGINT AS unstamped FROM (SELECT source, nullif(lang, 'fr') AS lang FROM documents)""",
)
def generated_keys(spark, sf_dir):
    """One id per key, one per row where a key column is NULL."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.nullif("lang", F.lit("fr")).alias("lang"))
    made = sinks.with_generated(docs, ["source", "lang"], order="doc_id")
    return made.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("keys"),
        F.count_if(F.col("inserted_at").isNull()).alias("unstamped"),
    )


@query(
    "append_new_counts",
    """WITH k AS (SELECT DISTINCT source, lang FROM documents), old AS (SELECT DISTINCT source, lang FROM documents
  WHERE doc_id % 3 = 0) SELECT (SELECT count(*) FROM old) AS before, (SELECT count(*) FROM k) AS after,
  (SELECT count(*) FROM k) - (SELECT count(*) FROM old) AS inserted,
  (SELECT count(*) FROM k) - (SELECT count(*) FROM old) AS expected, TRUE AS ok""",
)
def append_new_counts(spark, sf_dir):
    """K6, K8: a second batch adds only what the first did not hold."""
    docs, path = _documents(spark, sf_dir).select("doc_id", "source", "lang"), _path(spark, "appended")
    sinks.create_if_absent(spark, path, docs.schema)
    keys = ["source", "lang"]
    sinks.append_new(docs.where("doc_id % 3 = 0"), path, keys, order="doc_id")
    return sinks.append_new(docs, path, keys, order="doc_id")


@query("scan_by_name", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def scan_by_name(spark, sf_dir):
    """By a name of the catalog, with the columns that are asked for."""
    name = f"documents_{uuid4().hex}"
    _documents(spark, sf_dir).where("n_chars > 1000").createOrReplaceTempView(name)
    return tables.scan(spark, name, ["doc_id", "lang"])


@query(
    "describe_documents",
    """SELECT column_index AS ordinal, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint'
  ELSE 'string' END AS type, CASE WHEN column_name = 'doc_id' THEN 'SERIAL' WHEN data_type = 'BIGINT' THEN 'BIGINT'
  ELSE 'STRING' END AS display_type FROM (SELECT column_index, column_name, data_type FROM duckdb_columns()
  WHERE table_name = 'documents' QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY table_oid) = 1)""",
)
def describe_documents(spark, sf_dir):
    """The columns of a stored table."""
    described = tables.describe_columns(table(spark, sf_dir, "documents"), generated=("doc_id",))
    return described.select("ordinal", "name", "type", "display_type")


@query(
    "union_of_dialects",
    """SELECT doc_id, lang, NULL AS hotel_name FROM documents UNION ALL
SELECT doc_id, NULL, source FROM documents WHERE doc_id % 2 = 0""",
)
def union_of_dialects(spark, sf_dir):
    """Tables of two naming dialects and different columns as one."""
    docs = _documents(spark, sf_dir)
    titled = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("Doc ID"), F.col("source").alias("Hotel Name"))
    wide = docs.select("doc_id", "lang", F.lit(None).cast("string").alias("hotel_name"))
    return wide.unionByName(conform(normalize_columns(titled), wide.schema))

