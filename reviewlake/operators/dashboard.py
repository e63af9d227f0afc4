"""Dashboard aggregates: P5, P6, P11, A3-A5, A12, T1."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.text import word_tokens
from reviewlake.lexicons import literal_words


def filter_in(df: DataFrame, choices: Mapping[str, Iterable | None]) -> DataFrame:
    """P5: one IN filter per column; an empty or missing choice filters nothing."""
    conditions = [F.col(c).isin(list(v)) for c, v in choices.items() if v]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def distinct_choices(df: DataFrame, column: str, given: Mapping[str, Iterable | None] = {}) -> DataFrame:
    """Values to offer for ``column`` under the choices already made, NULL included."""
    return filter_in(df, given).select(column).distinct()


def counts_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """A3: group sizes; rows with a NULL in any grouping column are dropped."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n", by_value: bool = False) -> DataFrame:
    """A4 (most frequent first) or A5 (in value order)."""
    order = [F.asc(column)] if by_value else [F.desc(name), F.asc(column)]
    return counts_by(df, column, name=name).orderBy(*order)


def drop_sentinel(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    """Drop NULLs and one placeholder text, ignoring case."""
    return df.where(F.col(column).isNotNull() & (F.lower(column) != sentinel.lower()))


def lexicon_counts(
    df: DataFrame, text: str, words: Iterable[str], weight: Column | None = None
) -> DataFrame:
    """Occurrences of each listed word.

    Only listed words leave the row, and each task sends at most one count per
    word, so the shuffle is as small as the list.
    """
    listed = literal_words(words)
    hits = F.explode(F.filter(word_tokens(F.col(text)), lambda w: w.isin(listed)))
    times = F.lit(1) if weight is None else weight
    return (
        df.select(hits.alias("keyword"), times.cast("long").alias("_times"))
        .groupBy("keyword")
        .agg(F.sum("_times").alias("frequency"))
    )


def keyword_topk(
    df: DataFrame, text: str, words: Iterable[str], k: int = 10, weight: Column | None = None
) -> DataFrame:
    """The ``k`` most frequent listed words, ties in word order."""
    counts = lexicon_counts(df, text, words, weight)
    return counts.orderBy(F.desc("frequency"), F.asc("keyword")).limit(k)
