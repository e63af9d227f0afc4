"""Codes, labels, seasons and ratios."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from reviewlake.lexicons import (
    BOTH_SIDES,
    LABELS,
    NO_SIDE,
    ONLY_NEGATIVE,
    ONLY_POSITIVE,
    PARITY_LABELS,
    SEASON_BY_QUARTER,
    SENTIMENT_SENTINELS,
    SENTINELS_EXTENDED,
)


def is_present(c: Column, sentinels: Iterable[str]) -> Column:
    """A side was written: not NULL and not one of the "nothing" texts."""
    return F.coalesce(~c.isin(list(sentinels)), F.lit(False))


def classify_sentiment(
    negative: Column,
    positive: Column,
    parity: bool = False,
    sentinels: Iterable[str] | None = None,
) -> Column:
    """-1 both sides, 0 only negative, 1 only positive, 2 neither."""
    if sentinels is None:
        sentinels = SENTIMENT_SENTINELS if parity else SENTINELS_EXTENDED
    sentinels = list(sentinels)
    # Indexed by 2 * negative + positive, so that each side is evaluated once.
    codes = F.array(*[F.lit(c) for c in (NO_SIDE, ONLY_POSITIVE, ONLY_NEGATIVE, BOTH_SIDES)])
    neg, pos = is_present(negative, sentinels), is_present(positive, sentinels)
    return F.get(codes, neg.cast("int") * 2 + pos.cast("int"))


def sentiment_label(
    code: Column, parity: bool = False, labels: Mapping[int, str] | None = None
) -> Column:
    """F8: label of a code, NULL for codes without one."""
    labels = (PARITY_LABELS if parity else LABELS) if labels is None else labels
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, code)


def season(date: Column) -> Column:
    """season label for the quarter of a date."""
    table = F.create_map(*[F.lit(x) for pair in SEASON_BY_QUARTER.items() for x in pair])
    return F.try_element_at(table, F.quarter(date))


def season_matches(label: Column, target: str) -> Column:
    """F21, first pass: either text contains the other, ignoring case."""
    low, goal = F.lower(label), F.lit(target.lower())
    return low.contains(goal) | goal.contains(low)


def season_matches_part(label: Column, target: str) -> Column:
    """F21, second pass: the label contains one end of an ``A-B`` target."""
    parts = target.lower().split("-")
    if len(parts) != 2:
        return F.lit(False)
    return F.lower(label).contains(parts[0]) | F.lower(label).contains(parts[1])


def ratio_percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def on_day(timestamp: Column, day: Column | None = None) -> Column:
    """The timestamp falls on a day (today unless given)."""
    return F.to_date(timestamp) == (F.current_date() if day is None else F.to_date(day))
