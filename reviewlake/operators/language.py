"""Language of a text: English shortcut (F12) and trigram profiles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reviewlake.functions.arrays import let, run_lengths
from reviewlake.functions.text import letter_trigrams, strip
from reviewlake.lexicons import ENGLISH_PATTERNS
from reviewlake.operators.batch_counts import language_trigrams, trigram_sums
from reviewlake.session import persist_reliably

#: Largest number of profile cells (trigrams times languages, 8 bytes each) that is broadcast.
MAX_BROADCAST_CELLS = 4_000_000

#: Up to so many languages a text's scores are columns of one row.
MAX_LANGUAGE_COLUMNS = 100

#: Log-probabilities are kept as whole millionths, so that sums do not depend on
#: the order in which partitions are added up.
SCALE = 1_000_000


def pattern_hits(c: Column, patterns: Iterable[str] = ENGLISH_PATTERNS) -> Column:
    """How many of the substrings occur in the lower-cased, stripped text."""
    def body(low: Column) -> Column:
        return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in patterns])

    return let(F.lower(strip(c)), body)


def english_shortcut(
    c: Column, patterns: Iterable[str] = ENGLISH_PATTERNS, needed: int = 2
) -> Column:
    """true when the text needs no detector: missing, under 4 characters, or enough hits."""
    def body(text: Column) -> Column:
        return (F.length(text) < 4) | (pattern_hits(text, patterns) >= needed)

    return F.coalesce(let(strip(c), body), F.lit(True))


def fit_language_profiles(
    df: DataFrame, text: str, lang: str, profile_size: int | None = None
) -> DataFrame:
    """(lang, trigram, gain, floor) for the trigrams of each language.

    All trigrams belong to a profile, or the ``profile_size`` most frequent ones.

    ``floor`` is the add-one log-probability of an unseen trigram and ``gain``
    what a known one adds to it. The alphabet bounds the number of distinct
    trigrams, so each task's counts leave little to shuffle; with a size, the window
    drops all but that many rows per language on each task.
    """
    counts = persist_reliably(language_trigrams(df, text, lang))
    distinct = counts.select(F.count_distinct("trigram")).scalar()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    floors = totals.select(
        "lang",
        F.round(-F.log((F.col("total") + distinct).cast("double")) * SCALE).cast("long").alias("floor"),
    )
    if profile_size is not None:
        frequent_first = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("trigram"))
        ranked = counts.withColumn("_rank", F.row_number().over(frequent_first))
        counts = ranked.where(F.col("_rank") <= profile_size)
    gain = F.round(F.log((F.col("n") + 1).cast("double")) * SCALE).cast("long").alias("gain")
    profile = counts.select("lang", "trigram", gain)
    return profile.join(floors, "lang")


def _long_enough(text: str) -> Column:
    return F.coalesce(F.length(strip(F.col(text))) > 3, F.lit(False))


def _trigram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, trigram, tf) of the texts long enough to detect, counted inside the row."""
    counted = F.explode(run_lengths(letter_trigrams(F.col(text)))).alias("_t")
    return df.where(_long_enough(text)).select(key, counted).select(key, F.col("_t.term").alias("trigram"), "_t.tf")


def _best_language(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """(key, lang) for the texts that share a trigram with some profile.

    The profiles become one row per trigram with one gain per language. All
    trigrams of a text sit in one task, so its scores are added up before the only
    shuffle, which carries one row of whole numbers per text. Profiles that are small
    enough are broadcast and looked up in numpy; others are joined. More languages than
    make a sensible number of columns are scored as rows instead.
    """
    stored = persist_reliably(profiles)
    per_language = stored.groupBy("lang").agg(F.first("floor"))
    floors = sorted(tuple(r) for r in per_language.limit(MAX_LANGUAGE_COLUMNS + 1).collect())
    if not floors:
        return df.select(key, F.lit(None).cast("string").alias("lang")).limit(0)
    if len(floors) > MAX_LANGUAGE_COLUMNS:
        return _best_of_many_languages(_trigram_counts(df, key, text), key, stored)
    gains = [
        F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("gain"))), F.lit(0)).alias(f"_g{i}")
        for i, (lang, _) in enumerate(floors)
    ]
    wide = persist_reliably(stored.groupBy("trigram").agg(*gains))
    most = MAX_BROADCAST_CELLS // len(floors)
    if wide.limit(most + 1).count() <= most:
        summed = trigram_sums(df.where(_long_enough(text)), key, text, wide.toArrow(), len(floors))
        scored = summed.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_n", *(f"_g{i}" for i in range(len(floors))))])
    else:
        sums = [F.sum(F.col(f"_g{i}") * F.col("tf")).alias(f"_g{i}") for i in range(len(floors))]
        # The left join keeps unknown trigrams, so that the same pass counts them all.
        counted = _trigram_counts(df, key, text)
        scored = counted.join(wide, "trigram", "left").groupBy(key).agg(F.sum("tf").alias("_n"), *sums)
    candidates = [
        F.when(
            F.col(f"_g{i}") > 0,
            F.struct((-F.col(f"_g{i}") - F.col("_n") * floor).alias("cost"), F.lit(lang).alias("lang")),
        )
        for i, (lang, floor) in enumerate(floors)
    ]
    return scored.select(key, F.array_min(F.array(*candidates)).getField("lang").alias("lang"))


def _best_of_many_languages(counted: DataFrame, key: str, profiles: DataFrame) -> DataFrame:
    """The same with one row per text and language; any number of languages."""
    stored = persist_reliably(counted)
    sizes = stored.groupBy(key).agg(F.sum("tf").alias("_n"))
    scored = stored.join(profiles, "trigram").groupBy(key, "lang", "floor").agg(
        F.sum(F.col("gain") * F.col("tf")).alias("_g")
    )
    cost = F.struct((-F.col("_g") - F.col("_n") * F.col("floor")).alias("cost"), "lang")
    best = scored.where(F.col("_g") > 0).join(sizes, key).groupBy(key).agg(F.min(cost).alias("_best"))
    return best.select(key, F.col("_best.lang").alias("lang"))


def detect_language(
    df: DataFrame, key: str, text: str, profiles: DataFrame, default: str = "en"
) -> DataFrame:
    """(key, lang) with the most probable language of each text.

    Candidates are the languages that share a trigram with the text; ties go to
    the smaller code. Texts of three or fewer characters and texts without a
    known trigram get the default. ``key`` must be unique.
    """
    best = _best_language(df, key, text, profiles)
    detected = df.select(key).join(best, key, "left")
    return detected.withColumn("lang", F.coalesce("lang", F.lit(default)))


def tag_language(
    df: DataFrame,
    key: str,
    text: str,
    profiles: DataFrame,
    name: str = "lang",
    default: str = "en",
) -> DataFrame:
    """F12 first, F13 only for the texts the shortcut does not settle.

    Both sides of the join have one row per key, so no task sees a hot key; a
    second tag on the same key finds the rows already partitioned.
    """
    unsettled = df.where(~english_shortcut(F.col(text)))
    best = _best_language(unsettled, key, text, profiles)
    tagged = df.join(best.select(key, F.col("lang").alias("_best")), key, "left")
    return tagged.withColumn(name, F.coalesce("_best", F.lit(default))).drop("_best")
