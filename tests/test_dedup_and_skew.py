from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.operators.dedup import dedup_rows, duplicate_count, new_rows, relevant_keys
from reviewlake.operators.skew import hot_digests, salted_left_join

KEYS = ["city", "hotel_name", "reviewer_name", "review_date"]
SCHEMA = "id long, city string, hotel_name string, reviewer_name string, review_date string, note string"
BATCH = [
    (1, "Cairo", "h1", "R1", "d1", "a"),
    (2, "Cairo", "h1", "R2", "d1", "b"),
    (3, "Cairo", "h1", "R2", "d1", "c"),
    (4, None, "h1", "R3", "d1", "d"),
    (5, None, "h1", "R3", "d1", "e"),
]
TARGET = [(9, "Cairo", "h1", "R1", "d1", "old")]


@pytest.mark.parametrize("null_safe, expected", [(False, "bde"), (True, "bd")])
def test_golden_append(spark, null_safe, expected):
    batch, target = (spark.createDataFrame(r, SCHEMA) for r in (BATCH, TARGET))
    got = new_rows(batch, target, KEYS, null_safe=null_safe)
    assert got.columns == batch.columns
    assert sorted(r["note"] for r in got.collect()) == list(expected)


def test_null_key_in_target_counts_when_null_safe(spark):
    batch = spark.createDataFrame(BATCH, SCHEMA)
    target = spark.createDataFrame([(9, None, "h1", "R3", "d1", "old")], SCHEMA)
    assert {r["note"] for r in new_rows(batch, target, KEYS).collect()} == {"a", "b"}


def test_hot_key_append_equals_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", f"n{i}") for i in range(3000)]
    batch = spark.createDataFrame(rows, "id long, k string, note string").repartition(7)
    target = spark.createDataFrame([("k0",), ("k0",), ("zz",)], "k string")
    first = {}
    for i, k, n in rows:
        if k != "k0":
            first.setdefault(k, (i, k, n))
    got = new_rows(batch, target, ["k"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(first.values())


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_relevant_keys_do_not_change_the_append(spark, max_rows):
    batch, target = (spark.createDataFrame(r, SCHEMA) for r in (BATCH, TARGET))
    target = target.union(spark.createDataFrame([(8, None, "h1", "R3", "d1", "x"), (7, "Luxor", "h", "R", "d", "y")], SCHEMA))
    known = relevant_keys(target, batch, KEYS, max_rows)
    assert known.count() == (3 if max_rows == 1 else 2)
    for null_safe in (True, False):
        full, narrow = (new_rows(batch, t, KEYS, null_safe=null_safe) for t in (target, known))
        assert Counter(map(tuple, full.collect())) == Counter(map(tuple, narrow.collect()))


def test_duplicate_count(spark):
    batch, target = (spark.createDataFrame(r, SCHEMA) for r in (BATCH, TARGET))
    assert tuple(duplicate_count(batch, target, KEYS).first()) == (5, 4, 1)
    assert tuple(duplicate_count(batch.limit(0), target, KEYS).first()) == (0, 0, 0)
    nulls = target.union(batch.where("id = 4"))
    assert tuple(duplicate_count(batch, nulls, KEYS).first()) == (5, 4, 1)
    assert tuple(duplicate_count(batch, nulls, KEYS, null_safe=True).first()) == (5, 2, 3)


def test_dedup(spark):
    rows = [(3, "a", 1), (1, "a", 1), (2, "b", None), (4, "b", None), (5, "a", 2)]
    df = spark.createDataFrame(rows, "id long, t string, n int")
    assert {tuple(r) for r in dedup_rows(df).collect()} == {(1, "a", 1), (2, "b", None), (5, "a", 2)}
    assert {tuple(r) for r in dedup_rows(df, ["t"]).collect()} == {(1, "a", 1), (2, "b", None)}
    assert dedup_rows(df.union(df), df.columns).count() == 5


def test_rows_without_an_order_come_last(spark):
    df = spark.createDataFrame([(None, "a", "x"), (2, "a", "y"), (None, "b", "z")], "id long, t string, n string")
    assert {tuple(r) for r in dedup_rows(df, ["t"]).collect()} == {(2, "a", "y"), (None, "b", "z")}
    got = new_rows(df, spark.createDataFrame([("c",)], "t string"), ["t"])
    assert {tuple(r) for r in got.collect()} == {(2, "a", "y"), (None, "b", "z")}


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))
        ).alias("k"),
    )
    right = spark.range(0, 700, 2).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")
    ).union(spark.sql("SELECT 'hot', -1L"))
    got = salted_left_join(left, right, ["k"], salt_by="id", least_salts=8)
    plain = left.join(right, "k", "left").select("id", "k", "v")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_hot_key_is_spread(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.sql("SELECT 'hot' AS k, 1 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_left_join(left, right, ["k"], salt_by="id", rows_per_salt=64)
        sizes = [
            r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2400


def test_hot_digests_are_few(spark):
    even = spark.range(10_000).select((F.col("id") % 1000).alias("k"))
    assert hot_digests(even, ["k"], 0.01) == {}
    assert len(hot_digests(spark.range(1000).select((F.col("id") % 5).alias("k")), ["k"], 0.01)) == 5
