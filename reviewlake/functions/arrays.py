"""Array helpers (F18, F19, J5, U4) and a ``let`` for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.lexicons import literal_words, words_column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda body that mentions an outer expression evaluates it again for every
    element; binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of computing again.

    A filter on a computed column moves below the projection and takes a copy of the
    expression along. It does not move below a generator, and a generator over an array of
    one struct gives one row for each row.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def run_lengths(items: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct items with their counts.

    Row-local: the array is sorted and cut where the value changes, so counting
    terms per document needs no shuffle.
    """

    nothing = F.array().cast("array<struct<term:string,tf:bigint>>")

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        counted = let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).cast("long").alias("tf"),
                ),
            ),
        )
        return F.when(F.size(s) > 0, counted).otherwise(nothing)

    return let(F.sort_array(items), cut)


def members(tokens: Column, vocabulary: Iterable[str]) -> Column:
    """Sorted distinct tokens that belong to the vocabulary."""
    return F.sort_array(F.array_intersect(tokens, words_column(vocabulary)))


def sql_words(words: Iterable[str]) -> str:
    """``('a', 'b')`` for a SQL expression; one call for a list of thousands of words,
    where ``isin`` makes one call per word."""
    escaped = (w.replace("\\", "\\\\").replace("'", "\\'") for w in literal_words(words))
    return "(" + ", ".join(f"'{w}'" for w in escaped) + ")"


def empty_to_null(tokens: Column) -> Column:
    """An empty list is stored as NULL."""
    return F.when(F.size(tokens) > 0, tokens)


def array_literal(tokens: Column, quote: str = '"') -> Column:
    """the ``{"a","b"}`` text form, for CSV exports only."""
    escaped = F.transform(
        tokens, lambda t: F.concat(F.lit(quote), F.replace(t, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    )
    return F.when(F.size(tokens) > 0, F.concat(F.lit("{"), F.array_join(escaped, ","), F.lit("}")))


def array_length(tokens: Column) -> Column:
    """NULL for a NULL or empty array."""
    return F.when(F.size(tokens) > 0, F.size(tokens))


def item(tokens: Column, position: int) -> Column:
    """1-based access, NULL beyond the end."""
    return F.get(tokens, F.lit(position - 1))
