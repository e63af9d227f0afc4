"""F1-F7, U2, A5, A6, P8, P9 over documents and their review view."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import (
    SQL_REVIEWS,
    query,
    reviews,
    silver,
    sql_city,
    sql_clean,
    sql_cleaned,
    sql_duration,
    sql_stop,
    sql_strip,
    table,
)
from reviewlake.functions.text import (
    clean_duration,
    clean_review_date,
    clean_text,
    is_analysable,
    mark_empty,
    normalize_city,
    normalize_text,
    remove_stopwords,
)
from reviewlake.operators.dashboard import value_counts
from reviewlake.operators.dedup import dedup_rows
from reviewlake.operators.metrics import null_profile
from reviewlake.plans.cleaning import clean_columns, clean_reviews

REVIEW_COLUMNS = [
    "id", "city", "hotel_name", "reviewer_name", "duration", "travel_type", "review_date",
    "positive_review", "negative_review",
]


@query(
    "clean_text",
    f"""WITH c AS (SELECT doc_id, {sql_clean('text')} AS letters FROM documents),
s AS (SELECT doc_id, letters, {sql_stop('letters')} AS content FROM c)
SELECT doc_id, letters, content, CASE WHEN content = '' THEN '0' ELSE content END AS stored FROM s""",
)
def clean_text_query(spark, sf_dir):
    letters = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("letters"))
    content = letters.withColumn("content", remove_stopwords(F.col("letters")))
    return content.withColumn("stored", mark_empty(F.col("content"), parity=True))


@query(
    "normalize_text",
    f"SELECT conv_id, turn, coalesce(lower({sql_strip('text')}), '') AS text FROM conversations",
)
def normalize_text_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", normalize_text(F.col("text")).alias("text"))


@query(
    "analysable_texts",
    f"""SELECT source, count(*) AS n, count(*) FILTER (length({sql_strip('text')}) > 10) AS analysable
FROM documents GROUP BY source""",
)
def analysable_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(is_analysable(F.col("text"))).alias("analysable")
    )


@query("city_normalize", f"WITH {SQL_REVIEWS} SELECT id, {sql_city('city')} AS city FROM reviews")
def city_normalize(spark, sf_dir):
    return reviews(spark, sf_dir).select("id", normalize_city(F.col("city")).alias("city"))


@query(
    "duration_and_date_clean",
    f"""WITH {SQL_REVIEWS} SELECT id, {sql_duration('duration')} AS duration,
replace(review_date, 'Reviewed: ', '') AS review_date FROM reviews""",
)
def duration_and_date_clean(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        "id",
        clean_duration(F.col("duration")).alias("duration"),
        clean_review_date(F.col("review_date")).alias("review_date"),
    )


def _cleaned_sql(parity: bool) -> str:
    return f"""WITH {sql_cleaned(parity)}
SELECT {', '.join(REVIEW_COLUMNS)}, sentiment_classification FROM cleaned"""


@query("sentiment_classify", _cleaned_sql(False))
def sentiment_classify(spark, sf_dir):
    cleaned = clean_columns(reviews(spark, sf_dir))
    return cleaned.select(*REVIEW_COLUMNS, "sentiment_classification")


@query("sentiment_classify_parity", _cleaned_sql(True))
def sentiment_classify_parity(spark, sf_dir):
    cleaned = clean_columns(reviews(spark, sf_dir), parity=True)
    return cleaned.select(*REVIEW_COLUMNS, "sentiment_classification")


def _distribution_sql(parity: bool) -> str:
    return f"""WITH {sql_cleaned(parity)}
SELECT sentiment_classification, count(*) AS n FROM cleaned GROUP BY sentiment_classification"""


@query("sentiment_distribution", _distribution_sql(False))
def sentiment_distribution(spark, sf_dir):
    cleaned = silver(spark, sf_dir, "sentiment_classification")
    return value_counts(cleaned, "sentiment_classification", by_value=True)


@query("sentiment_distribution_parity", _distribution_sql(True))
def sentiment_distribution_parity(spark, sf_dir):
    cleaned = silver(spark, sf_dir, "sentiment_classification", parity=True)
    return value_counts(cleaned, "sentiment_classification", by_value=True)


_BUSINESS = [c for c in REVIEW_COLUMNS if c != "id"]


@query(
    "silver_cleaned",
    f"""WITH {sql_cleaned(False)},
kept AS (SELECT min(id) AS id FROM reviews GROUP BY {', '.join(_BUSINESS)})
SELECT {', '.join(REVIEW_COLUMNS)}, sentiment_classification FROM cleaned WHERE id IN (SELECT id FROM kept)""",
)
def silver_cleaned(spark, sf_dir):
    return clean_reviews(reviews(spark, sf_dir).drop("lang")).drop("ingestion_timestamp")


@query(
    "dedup_business_key",
    "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang",
)
def dedup_business_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return dedup_rows(docs, ["text", "lang"], order="doc_id")


@query(
    "dedup_first_row",
    """SELECT lang, text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source,
arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, text""",
)
def dedup_first_row(spark, sf_dir):
    return dedup_rows(table(spark, sf_dir, "documents"), ["lang", "text"], order="doc_id")


@query(
    "dedup_whole_row",
    "SELECT DISTINCT conv_id, turn, role, text FROM conversations",
)
def dedup_whole_row(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return dedup_rows(turns, turns.columns, order="conv_id")


def _profile_sql(columns) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS present, count(*) FILTER ({c} IS NULL) AS missing,
count(*) FILTER ({c} = '') AS empty FROM cleaned"""
        for c in columns
    ]
    return f"WITH {sql_cleaned(False)} " + " UNION ALL ".join(parts)


_PROFILED = ["city", "travel_type", "duration", "positive_review", "negative_review"]


@query("data_quality_profile", _profile_sql(_PROFILED))
def data_quality_profile(spark, sf_dir):
    # Only aggregates read the cleaned columns, so each text is cleaned once, and nothing is stored.
    return null_profile(clean_columns(reviews(spark, sf_dir)).select(*_PROFILED), *_PROFILED)
