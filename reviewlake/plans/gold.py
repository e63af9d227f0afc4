"""Silver -> gold: phrases, domain tokens and the target columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.arrays import compute_once, empty_to_null
from reviewlake.lexicons import DOMAIN_VOCABULARY, MAX_LITERAL_WORDS, STOPWORDS, word_frame
from reviewlake.operators.phrases import attach_phrases, key_phrases
from reviewlake.operators.tokens import (
    domain_tokens_by_table,
    drop_without_tokens,
    informative_tokens,
    phrase_tokens,
    row_domain_tokens,
)
from reviewlake.schemas import GOLD_REVIEWS, keep_known

TRANSLATED = {"positive": "positive_review_translated", "negative": "negative_review_translated"}


def fill_missing(df: DataFrame) -> DataFrame:
    """A missing translation is an empty text."""
    return df.fillna("", subset=list(TRANSLATED.values()))


def with_phrases(
    df: DataFrame, method: str = "tfidf", stopwords: Iterable[str] = STOPWORDS, **options
) -> DataFrame:
    """Top phrases per review side; each side is fitted on its own texts."""
    out = df
    for side, column in TRANSLATED.items():
        phrases = key_phrases(df, "id", column, method, stopwords=stopwords, **options)
        out = attach_phrases(out, "id", phrases, f"{side}_phrases")
    return out


def with_domain_tokens(
    df: DataFrame, vocabulary: Iterable[str] = DOMAIN_VOCABULARY, **filters
) -> DataFrame:
    """J5 on both sides; a vocabulary too long for the plan is joined as a table."""
    vocabulary = list(dict.fromkeys(vocabulary))
    if len(vocabulary) > MAX_LITERAL_WORDS:
        words = word_frame(df.sparkSession, vocabulary)
        for side in TRANSLATED:
            tokens = informative_tokens(phrase_tokens(F.col(f"{side}_phrases")), **filters)
            df = domain_tokens_by_table(df.withColumn("_tokens", tokens), "id", "_tokens", words, f"{side}_tokens")
        return df.drop("_tokens")
    return compute_once(
        df,
        **{
            f"{side}_tokens": row_domain_tokens(phrase_tokens(F.col(f"{side}_phrases")), vocabulary, **filters)
            for side in TRANSLATED
        },
    )


def to_gold(df: DataFrame) -> DataFrame:
    """Target names and order; empty token lists become NULL."""
    renamed = df.drop("positive_review", "negative_review").withColumnsRenamed(
        {column: f"{side}_review" for side, column in TRANSLATED.items()}
    )
    stored = {f"{side}_tokens": empty_to_null(F.col(f"{side}_tokens")) for side in TRANSLATED}
    return keep_known(renamed.withColumns(stored), GOLD_REVIEWS)


def build_gold(
    translated: DataFrame,
    vocabulary: Iterable[str] = DOMAIN_VOCABULARY,
    stopwords: Iterable[str] = STOPWORDS,
    method: str = "tfidf",
    **options,
) -> DataFrame:
    """Phrases -> tokens -> drop rows without tokens -> gold columns."""
    phrased = with_phrases(fill_missing(translated), method, stopwords, **options)
    tokens = with_domain_tokens(phrased, vocabulary)
    return to_gold(drop_without_tokens(tokens, "positive_tokens", "negative_tokens"))
