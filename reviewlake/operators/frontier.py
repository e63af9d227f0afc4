"""Crawl work queue and run limits: S7, K12, A2, A16, P14, T5, T6, F21."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reviewlake.functions.labels import on_day, ratio_percent, season_matches, season_matches_part
from reviewlake.lexicons import RUN_PRESETS
from reviewlake.operators.metrics import side_by_side


def pending_links(links: DataFrame, flag: str = "is_scraped") -> DataFrame:
    """Links not done yet; an unknown flag means not done."""
    return links.where(~F.coalesce(F.col(flag), F.lit(False)))


def mark_done(
    links: DataFrame, outcomes: DataFrame, key: str = "link", flag: str = "is_scraped"
) -> DataFrame:
    """The queue with the flag and a status set for the links in ``outcomes``.

    ``outcomes`` is (key, ok); a link tried twice counts as done if any try worked.
    A failed link gets status ``failed`` and keeps its flag, so it is tried again.
    """
    tried = outcomes.groupBy(key).agg(F.bool_or("ok").alias("_ok"))
    done = F.coalesce(F.col("_ok"), F.lit(False))
    status = F.when(F.col("_ok"), "done").when(~F.col("_ok"), "failed")
    return (
        links.join(tried, key, "left")
        .withColumn(flag, F.when(done, True).otherwise(F.col(flag)))
        .withColumn("status", status)
        .select(*links.columns, "status")
    )


def crawl_statistics(
    reviews: DataFrame,
    links: DataFrame,
    scraped_at: str = "scraped_at",
    flag: str = "is_scraped",
    day: Column | None = None,
) -> DataFrame:
    """A2: one row of queue and review counts; one pass over each table."""
    per_review = reviews.agg(
        F.count_if(on_day(F.col(scraped_at), day)).alias("reviews_today"),
        F.count("*").alias("total_reviews"),
    )
    done = F.coalesce(F.col(flag), F.lit(False))
    per_link = links.agg(
        F.count_if(done).alias("scraped_hotels"),
        F.count("*").alias("total_hotels"),
        F.count_if(~done).alias("unscraped_hotels"),
    ).withColumn("completion_rate", ratio_percent(F.col("scraped_hotels"), F.col("total_hotels")))
    return side_by_side(per_review, per_link)


def run_limits(preset: str) -> tuple[int | None, int | None]:
    """(links per run, pages per link) of a preset; an unknown name is an error."""
    if preset not in RUN_PRESETS:
        raise ValueError(f"unknown preset {preset!r}; choose from {sorted(RUN_PRESETS)}")
    return RUN_PRESETS[preset]


def limit_per_key(df: DataFrame, key: str, n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; ``None`` keeps all.

    The rank filter runs on each task before the shuffle, so a hot key sends at
    most ``n`` rows per task.
    """
    if n is None:
        return df
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def hash_order(key: str, seed: int) -> Column:
    """A reproducible shuffle position for a row, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled_limit(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` rows in a random order that depends only on key and seed."""
    order = [hash_order(key, seed), F.col(key)]
    return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)


def session_outcome(links: DataFrame, ok: str, max_links: int | None = None) -> DataFrame:
    """Processed, failed, successful and success rate of one run."""
    counts = links.agg(
        F.count(ok).alias("_tried"), F.count_if(~F.col(ok)).alias("failed")
    )
    processed = F.col("_tried") if max_links is None else F.least("_tried", F.lit(max_links))
    with_processed = counts.select(processed.cast("long").alias("processed"), "failed")
    good = F.greatest(F.col("processed") - F.col("failed"), F.lit(0))
    return with_processed.select(
        "processed", "failed", good.alias("successful"),
        ratio_percent(good, F.col("processed")).alias("success_rate"),
    )


def filter_season(df: DataFrame, label: str, target: str) -> DataFrame:
    """rows of the season asked for; a part of the target is tried only if
    no label matches as a whole."""
    whole = F.coalesce(season_matches(F.col(label), target), F.lit(False))
    part = F.coalesce(season_matches_part(F.col(label), target), F.lit(False))
    any_whole = df.agg(F.coalesce(F.bool_or(whole), F.lit(False))).scalar()
    return df.where(whole | (~any_whole & part))
