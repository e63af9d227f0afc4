"""Translation through a memory table: P8, P13, F17, J4, A15."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.functions.arrays import let
from reviewlake.functions.labels import ratio_percent
from reviewlake.functions.text import strip
from reviewlake.operators.skew import salted_left_join
from reviewlake.session import ship_package

#: Translator hook: texts and their language -> translations (None = failed).
Translator = Callable[[list[str], list[str]], list[str | None]]


def needs_translation(c: Column, sentinels: Iterable[str]) -> Column:
    """More than three characters and not one of the "nothing" texts."""
    excluded = list(sentinels)
    wanted = let(strip(c), lambda t: (F.length(t) > 3) & ~F.lower(t).isin(excluded))
    return F.coalesce(wanted, F.lit(False))


def translation_candidates(
    df: DataFrame, text: str, lang: str, sentinels: Iterable[str]
) -> DataFrame:
    """The distinct (lang, text) pairs worth translating."""
    wanted = needs_translation(F.col(text), sentinels) & (F.col(lang) != "en")
    return df.where(wanted).select(F.col(lang).alias("lang"), F.col(text).alias("text")).distinct()


def memory_misses(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Candidates the memory does not hold; both sides have unique keys."""
    return candidates.join(memory, ["lang", "text"], "left_anti")


def run_translator(misses: DataFrame, translator: Translator, batch: int = 50) -> DataFrame:
    """New memory rows for the misses. Failures are left out, so they can be retried."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                out = translator(part["text"].tolist(), part["lang"].tolist())
                yield part.assign(translated=out).dropna(subset=["translated"])

    ship_package(misses.sparkSession)
    return misses.select("lang", "text").mapInPandas(
        call, schema="lang string, text string, translated string"
    )


def _wanted(text: Column, lang: Column, sentinels: Iterable[str]) -> Column:
    return F.coalesce(needs_translation(text, sentinels) & (lang != "en"), F.lit(False))


def _lookup_key(key: str, text: Column, wanted: Column) -> Column:
    """A digest of the text, or a value of the row's own that no memory row has.

    The join moves 64 characters instead of texts, and rows that need no translation are
    spread over all tasks.
    """
    own = F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.when(wanted, F.sha2(text, 256)).otherwise(own)


def _memory_by_digest(memory: DataFrame) -> DataFrame:
    """(lang, _digest, _translated): one row per key, whatever the memory holds twice.

    The rank's limit works in each task before the shuffle, and nothing is aggregated by sorting.
    """
    digest = F.sha2(F.col("text"), 256).alias("_digest")
    keyed = memory.select("lang", digest, F.col("translated").alias("_translated"))
    first = F.row_number().over(Window.partitionBy("lang", "_digest").orderBy(F.asc_nulls_last("_translated")))
    return keyed.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def apply_memory(
    df: DataFrame,
    key: str,
    text: str,
    lang: str,
    memory: DataFrame,
    sentinels: Iterable[str],
    name: str,
) -> DataFrame:
    """``name`` is the translation where the memory has one, else the original.

    One text may be held very often, so the join salts its hot keys.
    """
    wanted = _wanted(F.col(text), F.col(lang), sentinels)
    keyed = df.withColumn("_digest", _lookup_key(key, F.col(text), wanted))
    known = _memory_by_digest(memory).withColumnRenamed("lang", lang)
    joined = salted_left_join(keyed, known, [lang, "_digest"], salt_by=key)
    return joined.withColumn(name, F.coalesce("_translated", text)).select(*df.columns, name)


def apply_memory_to_sides(
    df: DataFrame, key: str, sides: Mapping[str, Iterable[str]], memory: DataFrame
) -> DataFrame:
    """F17 on several text columns with one join: ``<side>_translated`` for each.

    ``sides`` maps a text column to its sentinels; its language is in ``<side>_lang``.
    ``key`` must be unique. A row becomes one lookup per side, of which the first carries
    the other columns, and the lookups of a row come together again by its key: the first
    takes the texts of those that follow it, so whole rows are sorted once and not aggregated.
    """
    others = [c for c in df.columns if c != key]
    row = F.struct(*others)
    row_type = df.select(row.alias("_row")).schema["_row"].dataType
    lookups = [
        F.struct(
            F.lit(i).alias("_side"),
            F.col(f"{side}_lang").alias("lang"),
            F.col(side).alias("_text"),
            _lookup_key(key, F.col(side), _wanted(F.col(side), F.col(f"{side}_lang"), sentinels)).alias("_digest"),
            (F.lit(None).cast(row_type) if i else row).alias("_row"),
        )
        for i, (side, sentinels) in enumerate(sides.items())
    ]
    long = df.select(key, F.inline(F.array(*lookups)))
    joined = salted_left_join(long, _memory_by_digest(memory), ["lang", "_digest"], salt_by=key)
    found = F.coalesce("_translated", "_text")
    in_order = Window.partitionBy(key).orderBy("_side")
    texts = joined.select(key, "_side", "_row", found.alias("_found"))
    again = texts.select(
        key,
        "_side",
        "_row",
        *[F.lead("_found", i).over(in_order).alias(f"{side}_translated") for i, side in enumerate(sides)],
    ).where("_side = 0")
    return again.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in others], *[f"{side}_translated" for side in sides])


def memory_hit_rate(df: DataFrame, lang: str, text: str) -> DataFrame:
    """Lookups, misses (first sight of a key), hits and hit rate.

    Texts are told apart by a 256-bit digest, so that counting them does not
    shuffle them.
    """
    seen = F.struct(F.col(lang), F.sha2(F.col(text), 256))
    stats = df.agg(F.count("*").alias("lookups"), F.count_distinct(seen).alias("misses"))
    hits = F.col("lookups") - F.col("misses")
    return stats.select(
        "lookups", "misses", hits.alias("hits"), ratio_percent(hits, F.col("lookups")).alias("hit_rate")
    )


def translation_coverage(df: DataFrame, *translated: str) -> DataFrame:
    """Rows with any translated side, as a share of all rows."""
    any_side = F.coalesce(*translated).isNotNull()
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(any_side).alias("with_translation"),
        ratio_percent(F.count_if(any_side), F.count("*")).alias("coverage_pct"),
    )
