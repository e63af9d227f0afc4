"""Run a named query in Spark and its SQL in DuckDB and compare them as row sets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as entry_points


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def as_rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty when equal, else a short account of the difference."""
    got = entry_points.queries()[name](spark, sf_dir)
    ours = as_rows(got.columns, [tuple(r) for r in got.collect()])
    relation = con.sql(entry_points.oracle_sql()[name])
    theirs = as_rows(relation.columns, relation.fetchall())
    if sorted(got.columns) != sorted(relation.columns):
        return f"columns {sorted(got.columns)} != {sorted(relation.columns)}"
    if ours == theirs:
        return "" if ours else "no rows"
    only_ours, only_theirs = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"{sum(ours.values())} vs {sum(theirs.values())} rows; only Spark ({len(only_ours)}): "
        f"{str(only_ours[:2])[:600]}; only SQL ({len(only_theirs)}): {str(only_theirs[:2])[:600]}"
    )
