"""Layer schemas and column-name handling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


_REVIEW_HEAD = ("city", "hotel_name", "reviewer_name", "reviewer_nationality", "duration")

BRONZE_REVIEWS = StructType(
    [StructField("id", LongType())]
    + _strings(*_REVIEW_HEAD, "check_in_date", "travel_type", "room_type", "review_date")
    + _strings("positive_review", "negative_review")
    + [StructField("scraped_at", TimestampType())]
)

BRONZE_LINKS = StructType(_strings("link", "name") + [StructField("is_scraped", BooleanType())])

SILVER_CLEANED = StructType(
    BRONZE_REVIEWS.fields[:-1]
    + [
        StructField("ingestion_timestamp", TimestampType()),
        StructField("sentiment_classification", IntegerType()),
    ]
)

SILVER_TRANSLATED = StructType(
    SILVER_CLEANED.fields + _strings("negative_review_translated", "positive_review_translated")
)

TRANSLATION_MEMORY = StructType(_strings("lang", "text", "translated"))

GOLD_REVIEWS = StructType(
    [StructField("id", LongType())]
    + _strings(*_REVIEW_HEAD, "check_in_date", "review_date", "travel_type", "room_type")
    + _strings("positive_review", "negative_review")
    + [
        StructField("sentiment_classification", IntegerType()),
        StructField("positive_tokens", ArrayType(StringType())),
        StructField("negative_tokens", ArrayType(StringType())),
        StructField("inserted_at", TimestampType()),
    ]
)

#: A gold row is a duplicate when these four columns match.
GOLD_KEYS = ["city", "hotel_name", "reviewer_name", "review_date"]


def snake_case(name: str) -> str:
    return "_".join(name.replace("-", " ").split()).lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Title Case dialect -> snake_case (``"Hotel Name"`` -> ``hotel_name``)."""
    names = [snake_case(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"columns collide after renaming: {names}")
    return df.toDF(*names)


def keep_known(df: DataFrame, order: StructType | Iterable[str]) -> DataFrame:
    """The known columns that exist, in the schema's order."""
    names = order.names if isinstance(order, StructType) else list(order)
    return df.select(*[c for c in names if c in df.columns])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to the layer schema; absent columns become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def missing_columns(df: DataFrame, schema: StructType) -> list[str]:
    return [f.name for f in schema if f.name not in df.columns]
