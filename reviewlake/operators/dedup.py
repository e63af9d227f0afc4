"""Duplicate handling: U2, J1, K6, K7.

All of it is one grouping on the key, or one ranking within it. Both shrink a hot
key to one row per task before the shuffle and treat NULL keys as equal, so no join
is needed. Ranking sorts by a digest of the key first: eight bytes decide almost
every comparison, and whole rows are only moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _first_of_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key, as a rank that Spark limits before the shuffle."""
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def dedup_rows(df: DataFrame, subset: Sequence[str] | None = None, order: str = "id") -> DataFrame:
    """One row per combination of the business columns, lowest ``order`` kept.

    ``subset`` defaults to every column but ``order``. Pass ``df.columns`` to
    compare whole rows, serial included.
    """
    subset = [c for c in df.columns if c != order] if subset is None else list(subset)
    if order in subset:
        return df.select(*df.columns).distinct()
    if set(df.columns) == {*subset, order}:
        return df.groupBy(*subset).agg(F.min(order).alias(order)).select(*df.columns)
    return _first_of_key(df, subset, F.asc_nulls_last(order))


def _no_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def new_rows(
    batch: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    order: str = "id",
    null_safe: bool = True,
) -> DataFrame:
    """Batch rows whose key is in neither the target nor an earlier row.

    The target's bare keys and the batch's rows are ranked together: a key whose
    first row comes from the target already exists, otherwise the smallest
    ``order`` of the batch wins. With ``null_safe=False`` a NULL in any key column
    never matches, so such rows skip the shuffle and are all new.
    """
    keys = list(keys)
    known = target.select(*keys)
    candidates = batch
    if not null_safe:
        known = known.where(_no_null(keys))
        candidates = batch.where(_no_null(keys))
    tagged = candidates.withColumn("_new", F.lit(True)).unionByName(
        known.withColumn("_new", F.lit(False)), allowMissingColumns=True
    )
    first = _first_of_key(tagged, keys, F.asc("_new"), F.asc_nulls_last(order))
    winner = first.where("_new").select(*batch.columns)
    return winner if null_safe else winner.unionByName(batch.where(~_no_null(keys)))


def relevant_keys(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], max_rows: int = 500_000
) -> DataFrame:
    """The target's keys that can matter for a stored ``batch``.

    For a small increment the digests of its distinct keys, 8 bytes each and counted
    first, are broadcast and only the target rows with one of them go on: the big table
    is scanned but not shuffled. Two keys of one digest only let a row more through. A
    larger batch gets all keys back.
    """
    keys = list(keys)
    wanted = batch.select(F.xxhash64(*keys).alias("_digest")).distinct()
    if wanted.limit(max_rows + 1).count() > max_rows:
        return target.select(*keys)
    digested = target.select(*keys, F.xxhash64(*keys).alias("_digest"))
    return digested.join(F.broadcast(wanted), "_digest", "left_semi").select(*keys)


def duplicate_count(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """K7: one row ``total, new, duplicates``; a batch row is new if no target row matches.

    Only counts leave the map side, never rows.
    """
    keys = list(keys)
    both = batch.select(*keys, F.lit(1).alias("_b")).unionByName(
        target.select(*keys, F.lit(0).alias("_b"))
    )
    per_key = both.groupBy(*keys).agg(F.sum("_b").alias("_rows"), F.min("_b").alias("_unseen"))
    matched = F.col("_unseen") == 0
    if not null_safe:
        matched = matched & _no_null(keys)
    totals = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~matched, F.col("_rows"))), F.lit(0)).alias("new"),
    )
    return totals.select("total", "new", (F.col("total") - F.col("new")).alias("duplicates"))
