"""Bronze -> silver -> translated -> gold, each layer written once and read back."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.lexicons import (
    DOMAIN_VOCABULARY,
    NO_TRANSLATION_NEGATIVE,
    NO_TRANSLATION_POSITIVE,
    STOPWORDS,
)
from reviewlake.operators.language import tag_language
from reviewlake.operators.metrics import gold_report, table_counts, translation_report
from reviewlake.operators.translate import (
    Translator,
    apply_memory_to_sides,
    memory_misses,
    run_translator,
    translation_candidates,
)
from reviewlake.plans.cleaning import to_silver, unique_reviews
from reviewlake.plans.gold import build_gold
from reviewlake.schemas import GOLD_REVIEWS, SILVER_TRANSLATED, TRANSLATION_MEMORY, keep_known
from reviewlake.sources.sinks import append_new, create_if_absent, overwrite, with_generated

SIDES = {
    "negative_review": NO_TRANSLATION_NEGATIVE,
    "positive_review": NO_TRANSLATION_POSITIVE,
}


def with_languages(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """``<side>_lang`` for both review sides."""
    for side in SIDES:
        df = tag_language(df, "id", side, profiles, name=f"{side}_lang")
    return df


def new_translations(df: DataFrame, memory: DataFrame, translator: Translator) -> DataFrame:
    """Translations of the distinct texts of both sides that the memory lacks."""
    candidates = None
    for side, sentinels in SIDES.items():
        part = translation_candidates(df, side, f"{side}_lang", sentinels)
        candidates = part if candidates is None else candidates.unionByName(part)
    return run_translator(memory_misses(candidates.distinct(), memory), translator)


def translate_sides(df: DataFrame, memory: DataFrame) -> DataFrame:
    """F17 on both sides; needs the ``<side>_lang`` columns."""
    return keep_known(apply_memory_to_sides(df, "id", SIDES, memory), SILVER_TRANSLATED)


def check_unique(df: DataFrame, key: str = "id") -> None:
    """Raise ValueError if two rows share a key or have none: texts are put back by it."""
    counted = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).first()
    if counted["rows"] != counted["keys"]:
        raise ValueError(f"{counted['rows']} rows have {counted['keys']} different values of {key!r}")


@dataclass(frozen=True)
class Layers:
    """Where the layers live."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def silver(self) -> str:
        return self.path("silver_cleaned")

    @property
    def memory(self) -> str:
        return self.path("translation_memory")

    @property
    def translated(self) -> str:
        return self.path("silver_translated")

    @property
    def gold(self) -> str:
        return self.path("gold_reviews")


def run_layers(
    spark: SparkSession,
    bronze: DataFrame,
    layers: Layers,
    profiles: DataFrame,
    translator: Translator | None = None,
    vocabulary: Iterable[str] = DOMAIN_VOCABULARY,
    stopwords: Iterable[str] = STOPWORDS,
    method: str = "tfidf",
    parity: bool = False,
) -> dict[str, DataFrame]:
    """Run every stage and return the reports.

    Each stage reads the table the stage before wrote, so nothing is computed
    twice and a lost executor costs at most one stage. Languages are detected on
    the raw texts; in parity mode on the cleaned ones, which have lost every
    letter outside a-z.
    """
    unique_path, tagged_path = layers.path("bronze_unique"), layers.path("tagged")
    overwrite(unique_reviews(bronze, parity), unique_path)
    unique = spark.read.parquet(unique_path)
    check_unique(unique)
    if parity:
        overwrite(to_silver(unique, parity, stopwords), layers.silver)
        overwrite(with_languages(spark.read.parquet(layers.silver), profiles), tagged_path)
        tagged = spark.read.parquet(tagged_path)
    else:
        overwrite(with_languages(unique, profiles), tagged_path)
        languages = [f"{side}_lang" for side in SIDES]
        raw = spark.read.parquet(tagged_path)
        overwrite(to_silver(raw, parity, stopwords, keep=languages), layers.silver)
        tagged = spark.read.parquet(layers.silver)
    silver = spark.read.parquet(layers.silver)

    create_if_absent(spark, layers.memory, TRANSLATION_MEMORY)
    memory = spark.read.parquet(layers.memory)
    if translator is not None:
        fresh_path = layers.path("translation_memory__new")
        overwrite(new_translations(tagged, memory, translator), fresh_path)
        spark.read.parquet(fresh_path).write.mode("append").parquet(layers.memory)
        spark.catalog.refreshByPath(layers.memory)
        memory = spark.read.parquet(layers.memory)
    overwrite(translate_sides(tagged, memory), layers.translated)
    translated = spark.read.parquet(layers.translated)

    create_if_absent(spark, layers.gold, GOLD_REVIEWS)
    batch_path = layers.path("gold_batch")
    overwrite(build_gold(translated, vocabulary, stopwords, method), batch_path)
    batch = spark.read.parquet(batch_path)
    # The batch's own id orders duplicates; the stored id is a hash of the key.
    ordered = with_generated(batch.withColumnRenamed("id", "_order"), order="_order")
    load = append_new(ordered, layers.gold, order="_order", null_safe=not parity)
    inserted = spark.read.parquet(f"{layers.gold}__staged")
    return {
        "counts": table_counts(
            bronze=bronze, silver=silver, translated=translated, gold=spark.read.parquet(layers.gold)
        ),
        "translation": translation_report(
            silver, translated, "negative_review_translated", "positive_review_translated"
        ),
        "load": load,
        "gold": gold_report(translated, batch, inserted),
    }
