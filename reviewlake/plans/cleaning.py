"""Bronze -> silver: the cleaning job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.labels import classify_sentiment
from reviewlake.functions.text import (
    clean_duration,
    clean_review_date,
    clean_text,
    mark_empty,
    normalize_city,
    remove_stopwords,
)
from reviewlake.lexicons import STOPWORDS
from reviewlake.operators.dedup import dedup_rows
from reviewlake.schemas import SILVER_CLEANED, keep_known

TEXT_COLUMNS = ("hotel_name", "negative_review", "positive_review")
SIDES = ("negative_review", "positive_review")


def clean_columns(
    df: DataFrame,
    parity: bool = False,
    stopwords: Iterable[str] = STOPWORDS,
    sentinels: Iterable[str] | None = None,
) -> DataFrame:
    """F1-F7 on the columns that exist; row-local, no shuffle, works on streams."""
    stopwords = list(stopwords)
    changed = {}
    for c in TEXT_COLUMNS:
        if c in df.columns:
            text = remove_stopwords(clean_text(F.col(c), parity), stopwords)
            changed[c] = mark_empty(text, parity) if c in SIDES else text
    if "city" in df.columns:
        changed["city"] = normalize_city(F.col("city"))
    if "duration" in df.columns:
        changed["duration"] = clean_duration(F.col("duration"), parity)
    if "review_date" in df.columns:
        changed["review_date"] = clean_review_date(F.col("review_date"), parity)
    cleaned = df.withColumns(changed)
    if all(c in df.columns for c in SIDES):
        code = classify_sentiment(
            F.col("negative_review"), F.col("positive_review"), parity, sentinels
        )
        cleaned = cleaned.withColumn("sentiment_classification", code)
    return cleaned


def unique_reviews(bronze: DataFrame, parity: bool = False) -> DataFrame:
    """U2 on bronze rows.

    In parity mode rows are compared with their serial ``id``. Otherwise the
    business columns decide and the lowest ``id`` stays.
    """
    if parity:
        return dedup_rows(bronze, bronze.columns)
    return dedup_rows(bronze, [c for c in bronze.columns if c not in ("id", "scraped_at")])


def clean_reviews(
    bronze: DataFrame,
    parity: bool = False,
    stopwords: Iterable[str] = STOPWORDS,
    sentinels: Iterable[str] | None = None,
) -> DataFrame:
    """Dedup, load time, cleaning, sentiment; the silver columns in order."""
    return to_silver(unique_reviews(bronze, parity), parity, stopwords, sentinels)


def to_silver(
    unique: DataFrame,
    parity: bool = False,
    stopwords: Iterable[str] = STOPWORDS,
    sentinels: Iterable[str] | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """The row-local part of the job; ``keep`` names extra columns."""
    stamped = unique.withColumn("ingestion_timestamp", F.current_timestamp())
    cleaned = clean_columns(stamped, parity, stopwords, sentinels)
    return keep_known(cleaned, [*SILVER_CLEANED.names, *keep])
