"""A left join that keeps hot keys from landing in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F


def key_digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_digests(df: DataFrame, keys: Sequence[str], hot_fraction: float = 0.01) -> dict[int, int]:
    """Rows by digest of the keys holding at least ``hot_fraction`` of the rows.

    There are at most ``1 / hot_fraction`` of them, whatever the size of ``df``, so
    they fit in the plan as literals. Counting is map-side combined on 8-byte keys.
    """
    rows = Observation()
    digests = df.select(key_digest(keys).alias("_digest")).observe(
        rows, F.count(F.lit(1)).alias("total")
    )
    counts = digests.groupBy("_digest").agg(F.count("*").alias("_n"))
    most = math.ceil(1 / hot_fraction)
    heaviest = counts.orderBy(F.desc("_n")).limit(most).collect()
    return {r["_digest"]: r["_n"] for r in heaviest if r["_n"] >= hot_fraction * rows.get["total"]}


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salt_by: str,
    rows_per_salt: int = 1_000_000,
    least_salts: int = 16,
    hot_fraction: float = 0.01,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys``, with hot keys spread over several tasks.

    A hot key's rows are counted, and it gets a salt for every ``rows_per_salt`` of them, so
    its tasks stay the same size however the table grows. Hot left rows get a salt from
    their own ``salt_by`` value, and the few right rows of those keys are repeated once per
    salt; all other rows carry salt 0 on both sides. The result equals the plain join. Hot
    keys are looked up when this is called; ``left`` should be a stored table.
    """
    keys = list(keys)
    hot = hot_digests(left, keys, hot_fraction)
    salts = F.lit(1)
    for digest, n in hot.items():
        wanted = max(least_salts, math.ceil(n / rows_per_salt))
        salts = F.when(key_digest(keys) == digest, wanted).otherwise(salts)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), salts).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    extra = [c for c in right.columns if c not in keys]
    return salted.join(
        repeated.select(*keys, "_salt", *extra), [*keys, "_salt"], "left"
    ).select(*left.columns, *extra)
