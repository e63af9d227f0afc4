"""A training-data pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept.
All but the last return the columns of ``documents``. Between stages ``run`` writes Parquet to
the shared checkpoint folder, so a lost executor or a failed stage does not repeat the ones
before it.

The pipeline has no SQL: automata, XXH64 fingerprints and tokenizers are not in it. The tests
compare every stage with a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import containment, cross_parsing, packing, secret_scan, simhash
from reviewlake.llm.queries import BYTE_BPE, PACK_END_ID, learning_part, scratch, table
from reviewlake.llm.shipping import prepare_session

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach."""
    prepare_session(spark)
    return cross_parsing.keep_known_language(docs, cross_parsing.fit_profiles(docs.filter(~learning_part(5, 0))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 4-word shingles, up to 4 differing bits."""
    prepare_session(spark)
    return simhash.keep_one_of_each_group(docs, n=4, max_distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare_session(spark)
    return containment.without_contained_items(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    prepare_session(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens, mixed by source."""
    prepare_session(spark)
    return packing.pack(docs, BYTE_BPE, PACK_END_ID)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
