"""Text expressions: cleaning (F1-F6), tokens (F9, F10) and n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from reviewlake.functions.arrays import empty_strings, let
from reviewlake.lexicons import CITIES, CONTRACTIONS, STOPWORDS, literal_words

# Unicode white space, spelled out so that it does not depend on a regex flag.
_SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                 (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                 (0x3000, 0x3000)]
WHITESPACE = "".join(chr(c) for lo, hi in _SPACE_RANGES for c in range(lo, hi + 1))

# The same set as a Java class; a long list of single characters is slow there.
_SPACE = r"[\s\x1c-\x1f]"
# One pass for "everything but letters and white space becomes a blank, then runs
# of white space become one blank": a run of two or more other characters is one
# blank, and so is a single one that is not white space.
NOT_LETTERS = rf"(?U)[^a-zA-Z](?:[^a-zA-Z]+|(?<!{_SPACE}))"
NOT_ALNUM = r"(?U)[^0-9a-zA-Z\s\x1c-\x1f]"
BLANKS = rf"(?U){_SPACE}+"
WORD = r"[\p{L}\p{N}_]+"
VECTORIZER_WORD = r"[\p{L}\p{N}_]{2,}"
ASCII_WORD = r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"
REVIEW_DATE_PREFIX = "Reviewed: "


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_text(c: Column) -> Column:
    """stripped and lower-cased; a missing text is ``''``."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def as_text(c: Column) -> Column:
    """Parity form of a NULL: the word ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def clean_text(c: Column, parity: bool = False) -> Column:
    """letters and single spaces only, lower-case."""
    c = as_text(c) if parity else c
    return F.lower(strip(F.regexp_replace(c, NOT_LETTERS, " ")))


def remove_stopwords(
    c: Column,
    stopwords: Iterable[str] = STOPWORDS,
    contractions: Mapping[str, str] = CONTRACTIONS,
) -> Column:
    """drop stop words and join the rest with one space; blank passes through."""
    stop = literal_words(stopwords)
    halves = [parts.split(" ") for parts in contractions.values()]
    first_half = "|".join(rf"{a}(?={b}\b)" for a, b in halves)

    def body(text: Column) -> Column:
        split_up = text
        if halves:
            # Few texts hold one, and a plain search is much cheaper than the pattern.
            held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(a + b)) for a, b in halves])
            split_up = F.when(held, F.regexp_replace(text, rf"\b({first_half})", "$1 ")).otherwise(text)
        tokens = F.split(strip(split_up), BLANKS)
        kept = F.filter(tokens, lambda t: ~F.lower(t).isin(stop)) if stop else tokens
        return F.when(strip(text) == "", text).otherwise(F.array_join(kept, " "))

    return let(c, body)


def normalize_city(c: Column, cities: Iterable[str] = CITIES) -> Column:
    """the first listed city the text mentions, else NULL."""
    def body(low: Column) -> Column:
        return F.coalesce(*[F.when(low.contains(city.lower()), F.lit(city)) for city in cities])

    return let(F.lower(c), body)


def clean_duration(c: Column, parity: bool = False) -> Column:
    """punctuation becomes a blank; nothing is trimmed or collapsed."""
    return F.regexp_replace(as_text(c) if parity else c, NOT_ALNUM, " ")


def clean_review_date(c: Column, parity: bool = False) -> Column:
    """the literal prefix goes wherever it occurs."""
    return F.replace(as_text(c) if parity else c, F.lit(REVIEW_DATE_PREFIX), F.lit(""))


def mark_empty(c: Column, parity: bool = False) -> Column:
    """an empty text is stored as ``'0'`` (parity) or NULL."""
    marker = F.lit("0" if parity else None)
    return let(c, lambda text: F.when(text == "", marker).otherwise(text))


def word_tokens(c: Column) -> Column:
    """Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def ascii_tokens(c: Column) -> Column:
    """runs of a-z that touch no digit, underscore or accented letter."""
    return F.regexp_extract_all(F.lower(c), F.lit(ASCII_WORD), 0)


def vectorizer_tokens(c: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Words of two or more characters without the stop words, in text order."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(VECTORIZER_WORD), 0)
    stop = literal_words(stopwords)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs joined by one blank."""

    def pairs(t: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(t) - 2),
            lambda i: F.concat(F.get(t, i), F.lit(" "), F.get(t, i + 1)),
        )

    return let(tokens, lambda t: F.when(F.size(t) > 1, pairs(t)).otherwise(empty_strings()))


def unigrams_and_bigrams(tokens: Column) -> Column:
    return let(tokens, lambda t: F.concat(t, bigrams(t)))


def letter_trigrams(c: Column) -> Column:
    """One trigram per letter of the lower-cased text, with its neighbours.

    Anything that is not a letter counts as one blank, so words are padded. The
    lookahead walks the text once; cutting substrings by position would be
    quadratic on long texts.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(r"(?=(.[^ ].))"), 1)


def is_analysable(c: Column, min_length: int = 10) -> Column:
    """More than ``min_length`` characters once stripped; NULL is not."""
    return F.coalesce(F.length(strip(c)) > min_length, F.lit(False))
