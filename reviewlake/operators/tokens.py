"""Domain tokens: A11, A18, F11, J3, J5, P7, A9, A10, A14."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.arrays import empty_strings, members
from reviewlake.functions.labels import ratio_percent
from reviewlake.functions.text import ascii_tokens
from reviewlake.lexicons import (
    CATEGORY_TERMS,
    DOMAIN_VOCABULARY,
    HOTEL_STOPWORDS,
    MAX_LITERAL_WORDS,
    STOPWORDS,
    category_frame,
    literal_words,
    word_frame,
)


def informative_tokens(
    tokens: Column,
    stopwords: Iterable[str] = STOPWORDS,
    domain_stopwords: Iterable[str] = HOTEL_STOPWORDS,
    names: Iterable[str] = (),
    min_length: int = 3,
) -> Column:
    """drop short tokens, stop words, domain stop words and person names."""
    banned = literal_words([*stopwords, *domain_stopwords, *(n.lower() for n in names)])
    long_enough = F.filter(tokens, lambda t: F.length(t) >= min_length)
    return F.filter(long_enough, lambda t: ~t.isin(banned)) if banned else long_enough


def phrase_tokens(phrases: Column) -> Column:
    """F10 over a list of phrases, flattened."""
    return F.flatten(F.transform(phrases, lambda p: ascii_tokens(p)))


def corpus_vocabulary(df: DataFrame, tokens: Column, **filters: Iterable[str]) -> DataFrame:
    """The distinct informative tokens of the whole corpus, one per row.

    Filters and per-row dedup run before the explode, so that the shuffle sees
    each token at most once per task.
    """
    kept = F.array_distinct(informative_tokens(tokens, **filters))
    return df.select(F.explode(kept).alias("token")).distinct()


def _corpus_members(df: DataFrame, tokens: Column, words: Iterable[str], filters: dict) -> DataFrame:
    """(token): the distinct informative tokens of the corpus that are in the list.

    Tokens are tested inside the row, or against a broadcast of a list too long for the
    plan, so only tokens of the list take part in the distinct.
    """
    words = list(dict.fromkeys(words))
    kept = informative_tokens(tokens, **filters)
    if len(words) <= MAX_LITERAL_WORDS:
        return df.select(F.explode(members(kept, words)).alias("token")).distinct()
    listed = F.broadcast(word_frame(df.sparkSession, words))
    every = df.select(F.explode(F.array_distinct(kept)).alias("token"))
    return every.join(listed, "token", "left_semi").distinct()


def domain_tokens_of_corpus(
    df: DataFrame, tokens: Column, words: Iterable[str] = DOMAIN_VOCABULARY, **filters: Iterable[str]
) -> DataFrame:
    """The corpus tokens that are domain terms, one per row."""
    return _corpus_members(df, tokens, words, filters)


def row_domain_tokens(
    tokens: Column, vocabulary: Iterable[str] = DOMAIN_VOCABULARY, **filters: Iterable[str]
) -> Column:
    """J5 without its corpus-wide barrier.

    A row's token is always in the corpus list, so "in the corpus list" means "is
    informative and a domain term". Both tests fold into one short word list.
    """
    stop = {
        *filters.get("stopwords", STOPWORDS),
        *filters.get("domain_stopwords", HOTEL_STOPWORDS),
        *(n.lower() for n in filters.get("names", ())),
    }
    min_length = filters.get("min_length", 3)
    terms = [w for w in literal_words(vocabulary) if len(w) >= min_length and w not in stop]
    return members(tokens, sorted(terms))


def domain_tokens_by_table(df: DataFrame, key: str, tokens: str, words: DataFrame, name: str) -> DataFrame:
    """J5 with a word table (token) of any length instead of a list in the plan.

    ``key`` must be unique. The distinct tokens of each row meet the words in a join and
    come back as one sorted list per row, empty where there is none.
    """
    rows = df.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    found = rows.join(words.select("token").distinct(), "token", "left_semi")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list("token")).alias(name))
    return df.join(lists, key, "left").withColumn(name, F.coalesce(name, empty_strings()))


def drop_without_tokens(df: DataFrame, first: str, second: str) -> DataFrame:
    """Keep rows with a token on either side."""
    return df.where((F.size(first) > 0) | (F.size(second) > 0))


def token_categories(
    df: DataFrame,
    tokens: Column,
    categories: Mapping[str, Iterable[str]] = CATEGORY_TERMS,
    first: int = 10,
    **filters: Iterable[str],
) -> DataFrame:
    """Per category the number of distinct tokens and the first few, sorted.

    A token counts for the first category that lists it. Only listed tokens are shuffled,
    and a category's tokens are at most its list.
    """
    listed = category_frame(df.sparkSession, categories)
    words = [term.lower() for terms in categories.values() for term in terms]
    found = _corpus_members(df, tokens, words, filters).join(F.broadcast(listed), "token")
    return found.groupBy("category", "priority").agg(
        F.count("*").alias("n_tokens"),
        F.slice(F.sort_array(F.collect_list("token")), 1, first).alias("first_tokens"),
    )


def token_totals(df: DataFrame, positive: str, negative: str) -> DataFrame:
    """Totals, means and empty counts per side, in one pass."""
    pos, neg = F.size(positive), F.size(negative)
    return df.agg(
        F.count("*").alias("reviews"),
        F.coalesce(F.sum(pos), F.lit(0)).alias("positive_tokens"),
        F.coalesce(F.sum(neg), F.lit(0)).alias("negative_tokens"),
        F.avg(pos).alias("positive_per_review"),
        F.avg(neg).alias("negative_per_review"),
        F.count_if(pos == 0).alias("empty_positive"),
        F.count_if(neg == 0).alias("empty_negative"),
        F.count_if((pos == 0) & (neg == 0)).alias("empty_both"),
        ratio_percent(F.count_if((pos > 0) | (neg > 0)), F.count("*")).alias("retention_pct"),
    )


def size_distribution(df: DataFrame, *columns: str) -> DataFrame:
    """A10: min, max, mean and median list size per column, one row each.

    The exact median keeps one counter per distinct size, and sizes are few.
    """
    sizes = F.explode(
        F.array(*[F.struct(F.lit(c).alias("side"), F.size(c).alias("n")) for c in columns])
    )
    return (
        df.select(sizes.alias("s"))
        .groupBy("s.side")
        .agg(
            F.min("s.n").alias("min_tokens"),
            F.max("s.n").alias("max_tokens"),
            F.avg("s.n").alias("mean_tokens"),
            F.median("s.n").alias("median_tokens"),
        )
    )


def sentiment_slice(df: DataFrame, code: int, tokens: str, code_column: str) -> DataFrame:
    """Rows of one sentiment code that have tokens."""
    return df.where((F.col(code_column) == code) & (F.size(tokens) > 0))
