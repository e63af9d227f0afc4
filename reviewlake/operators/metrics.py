"""Counts, audits and step reports: A1, A6-A8, A16, A17, K8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.labels import ratio_percent


def table_counts(**tables: DataFrame) -> DataFrame:
    """A1: (layer, rows), one row per table."""
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a cross join."""
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def preview(df: DataFrame, n: int, *order: Column, non_empty: tuple[str, ...] = ()) -> DataFrame:
    """T4: the first ``n`` rows in a given order; with ``non_empty``, only rows where
    one of these list columns has an item."""
    if non_empty:
        df = df.where(reduce(lambda a, b: a | b, [F.size(c) > 0 for c in non_empty]))
    return df.orderBy(*order).limit(n)


def null_profile(df: DataFrame, *columns: str, empty: str = "") -> DataFrame:
    """Per column the rows that are present, missing and empty; one pass."""
    columns = columns or tuple(df.columns)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("present"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.count_if(F.col(c).cast("string") == empty).alias("empty"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def load_audit(df: DataFrame, loaded_at: str) -> DataFrame:
    """Total rows, distinct load dates, first and latest load."""
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_distinct(F.to_date(loaded_at)).alias("distinct_load_dates"),
        F.min(loaded_at).alias("first_load"),
        F.max(loaded_at).alias("latest_load"),
    )


def array_audit(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a stored list and the list lengths, per array column."""
    audits = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("stored"),
            F.min(F.when(F.col(c).isNotNull(), F.size(c))).alias("min_length"),
            F.max(F.when(F.col(c).isNotNull(), F.size(c))).alias("max_length"),
        )
        for c in columns
    ]
    return df.agg(F.array(*audits).alias("a")).select(F.inline("a"))


def reconcile(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """K8: one row ``before, after, inserted, expected, ok`` from three tables."""
    counts = table_counts(before=before, after=after, expected=expected).agg(
        *[F.sum(F.when(F.col("layer") == n, F.col("rows"))).alias(n) for n in ("before", "after", "expected")]
    )
    inserted = F.col("after") - F.col("before")
    return counts.select(
        "before", "after", inserted.alias("inserted"), "expected",
        (inserted == F.col("expected")).alias("ok"),
    )


def crawl_status(failed: Column, reviews: Column) -> Column:
    """A run without failures succeeded; with failures it needs reviews."""
    return (
        F.when(failed == 0, "SUCCESS").when(reviews > 0, "PARTIAL SUCCESS").otherwise("FAILED")
    )


def step_status(produced: Column) -> Column:
    """A step succeeded when it produced rows."""
    return F.when(produced > 0, "SUCCESS").otherwise("FAILED")


def crawl_report(outcome: DataFrame, reviews: DataFrame, links: DataFrame) -> DataFrame:
    """The crawl's counts and status; each input is reduced to one row first."""
    counts = table_counts(reviews=reviews, links=links).agg(
        F.sum(F.when(F.col("layer") == "links", F.col("rows"))).alias("total_hotels"),
        F.sum(F.when(F.col("layer") == "reviews", F.col("rows"))).alias("total_reviews"),
    )
    return side_by_side(counts, outcome).select(
        "total_hotels", "processed", "failed", "success_rate", "total_reviews",
        crawl_status(F.col("failed"), F.col("total_reviews")).alias("status"),
    )


def translation_report(source: DataFrame, translated: DataFrame, *columns: str) -> DataFrame:
    """Rows in, rows out, translation coverage and status."""
    any_side = F.coalesce(*columns).isNotNull()
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("w")).unionByName(
        translated.select(F.lit(0).alias("s"), F.lit(1).alias("t"), any_side.cast("int").alias("w"))
    )
    sums = both.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in (("s", "source_rows"), ("t", "translated_rows"), ("w", "with_translation"))
        ]
    )
    return sums.select(
        "*",
        ratio_percent(F.col("with_translation"), F.col("translated_rows")).alias("coverage_pct"),
        step_status(F.col("translated_rows")).alias("status"),
    )


def gold_report(source: DataFrame, gold: DataFrame, inserted: DataFrame) -> DataFrame:
    """Rows in, tokens per side, rows out and status of the gold step."""
    tokens = gold.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).alias(c)
            for c in ("positive_tokens", "negative_tokens")
        ]
    )
    counts = table_counts(source=source, final=gold, ingested=inserted).agg(
        *[
            F.sum(F.when(F.col("layer") == n, F.col("rows"))).alias(f"{n}_rows")
            for n in ("source", "final", "ingested")
        ]
    )
    return side_by_side(counts, tokens).withColumn("status", step_status(F.col("ingested_rows")))
