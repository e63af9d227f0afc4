"""Fingerprints of texts, of edited texts, and their likeness to the next document.

Documents follow each other in descending doc_id order, and after the last comes the first.
Bounds of the doc_ids cut the order into ranges; a copy of each range's first row is added
to the range before it, so a range knows all its successors and no row waits for another
task. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.minhash import PERMUTATIONS, SHINGLE_WORDS, likeness, signatures, written
from reviewlake.llm.text_arrays import groups

MAX_RANGES = 10_000
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, digest binary"
)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """One row of ``RESULT`` for each row of ``docs`` (doc_id, text); ``digest`` is the text's MD5.

    NULL texts are empty; rows with one doc_id follow each other in the order of their texts;
    a NULL doc_id comes last; one row alone is its own successor; other columns are
    ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key)
    ranges = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(b) for b in texts.select("key").approxQuantile("key", shares, 0.25 / ranges)})
    # Range 0 holds the largest ids.
    number = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b > F.col("key")))
    placed = texts.withColumn("range", number).withColumn("after", F.lit(False))
    heads = placed.groupBy("range").agg(F.max("key").alias("key")).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], RESULT)
    before = [(r["key"], r["range"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(before, "key long, range int, goes_to int"))
    firsts = placed.join(wanted, ["key", "range"]).groupBy("doc_id", "key", "goes_to").agg(F.min("text").alias("text"))
    ahead = firsts.select("doc_id", "text", "key", F.col("goes_to").alias("range"), F.lit(True).alias("after"))
    dealt = placed.unionByName(ahead).repartition("range")
    ordered = dealt.sortWithinPartitions("range", "after", F.desc("key"), "text").select("doc_id", "text", "after")

    def results(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
        own = [t for _, t, _ in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][2]]
        changed = [edited(own[i], own[i + 1]) for i in pairs]
        plain, other = signatures(own, n, permutations), signatures(changed, n, permutations)
        here, there = plain[pairs], plain[[i + 1 for i in pairs]]
        columns = [
            pa.array([rows[i][0] for i in pairs], pa.int64()),
            pa.array([len(own[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(written(here), pa.string()),
            pa.array(written(other), pa.string()),
            pa.array(likeness(here, other)),
            pa.array(likeness(here, there)),
            pa.array([hashlib.md5(own[i].encode()).digest() for i in pairs], pa.binary()),
        ]
        return pa.record_batch(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple[int | None, str, bool]] = []
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for lo, hi in groups([t for _, t, _ in rows]):
                some = carried + rows[lo:hi]
                carried = some[-1:]
                if len(some) > 1:
                    yield results(some)

    return ordered.mapInArrow(run, RESULT)
