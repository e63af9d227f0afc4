"""Running totals over an order without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewlake.session import persist_reliably

#: Rows summed up in one step of a running total.
RUN = 4096


def running_start(df: DataFrame, position: str, value: str, start: str) -> DataFrame:
    """Add ``start``, the sum of ``value`` over the rows with a smaller ``position``.

    ``position`` is a unique whole number. Rows are summed in runs of ``RUN`` positions,
    the runs' sums are added up in one task, and both windows see a bounded number of
    rows for up to ``RUN`` squared positions. The result is stored.
    """
    runs = df.withColumn("_run", F.floor(F.col(position) / RUN))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("_run").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_run").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_in_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = placed.join(totals, "_run").withColumn(start, F.col("_base") + F.col("_in_run"))
    return persist_reliably(out.select(*df.columns, start))
