"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``d`` bits share a variant that is at most
``ceil(d / 2)`` flips from one and ``floor(d / 2)`` from the other. Every distinct
fingerprint emits all its variants, variants are shuffled, and those met by more than one
fingerprint give links. Nothing is missed, and no group is large: a variant can be met by
at most as many fingerprints as a ball has points, 2081 for 4 bits of 64.

For ``n`` different fingerprints there are ``2081 * n`` variants. Variants travel packed, ten
bytes each, in one row per bucket and chunk. A variant's bucket is a linear hash of its
bits, so a round can enumerate just the variants of its share of the buckets; the rounds
run one after the other and each one's shuffle files are removed when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.llm.components import connected_components
from reviewlake.llm.text_arrays import groups, mix
from reviewlake.session import broadcast_if_bounded, persist_reliably, scratch_path

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: Each round shuffles one part in ``2**ROUND_BITS`` of the variants.
ROUND_BITS = 3
BUCKET_VARIANTS = 1 << 20
CHUNK = 2048
#: Rows' 16-byte keys are broadcast up to this many (16 MB), and joined by a shuffle beyond.
MAX_BROADCAST_ROWS = 1_000_000

_SPREAD = np.uint64(0x0101010101010101)


def shingles(text: str, n: int = SHINGLE_WORDS) -> list[bytes]:
    """Space-joined shingles of ``n`` words of the text with A-Z in lower case.

    Words are separated by spaces, tabs, line and page breaks (bytes 9 to 13 and 32).
    Fewer words are one shingle, no words none.
    """
    words = text.encode().lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n])).tolist()
    return [whole[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its hashes: bits set in over half of them.

    Eight bits at a time are added in the bytes of one word, over runs of up to 255
    hashes so that no byte overflows.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    begins = np.cumsum(n) - n
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(begins - 255 * first_run, runs) + 255 * np.arange(runs.sum())
    bits = np.zeros((len(full), BITS), dtype=np.uint8)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _SPREAD, starts)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run)
        bits[:, k::8] = 2 * sums > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint): a 64-bit whole number for each row's whole text.

    A NULL text counts as empty; a text without words has fingerprint 0.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _fingerprinted(chosen, n)


def _fingerprinted(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with a fingerprint in place of their last column, a text that is never NULL."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            values = []
            for lo, hi in groups(texts):
                hashes, counts = [], []
                for text in texts[lo:hi]:
                    found = shingles(text, n)
                    hashes += [digest(s, SEED) for s in found]
                    counts.append(len(found))
                values.append(majority_bits(np.array(hashes, dtype=np.uint64), np.array(counts)))
            column = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(column)], names=[*kept, "fingerprint"])

    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*types, "fingerprint long"]))


def ball(radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of 64 bits, fewest bits first."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return np.array(masks, dtype=np.uint64)


def bucket_of(values: np.ndarray, bits: int) -> np.ndarray:
    """A linear hash: the bucket of ``a ^ b`` is the bucket of ``a`` xor that of ``b``."""
    out = np.zeros(values.shape, dtype=np.int64)
    for k, mask in enumerate(mix(np.arange(1, bits + 1, dtype=np.uint64))):
        out |= (np.bitwise_count(values & mask) & 1).astype(np.int64) << k
    return out


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end instead of some time later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(node, other): links between different fingerprints of at most ``max_distance`` bits.

    ``distinct`` is a stored column ``fingerprint`` without repeats. Of the fingerprints
    that meet in a variant each is linked to the smallest near one, so links connect what
    is within the distance without listing all pairs; each link is verified.
    """
    spark = distinct.sparkSession
    near = max_distance // 2
    flips = ball(max_distance - near)
    total = distinct.count() * len(flips)
    bits = max(ROUND_BITS, min(24, (total // BUCKET_VARIANTS).bit_length()))
    flip_buckets = bucket_of(flips, bits)
    share = (1 << ROUND_BITS) - 1
    by_share = [np.flatnonzero((flip_buckets & share) == s) for s in range(share + 1)]
    small = np.uint16 if len(flips) <= 1 << 16 else np.uint32
    tasks = max(spark.sparkContext.defaultParallelism, 1 << (bits - ROUND_BITS))

    def emit(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(column), CHUNK):
                chunk = column[at : at + CHUNK]
                own = bucket_of(chunk, bits)
                variants, buckets, used = [], [], []
                for s in range(share + 1):
                    rows, picked = np.flatnonzero((own & share) == s), by_share[s ^ turn]
                    variants.append((chunk[rows, None] ^ flips[picked]).ravel())
                    buckets.append(((own[rows, None] ^ flip_buckets[picked]) >> ROUND_BITS).ravel())
                    used.append(np.tile(picked.astype(small), len(rows)))
                bucket = np.concatenate(buckets)
                order = np.argsort(bucket.astype(np.uint16) if bits - ROUND_BITS <= 16 else bucket, kind="stable")
                bucket, variant, flip = bucket[order], np.concatenate(variants)[order], np.concatenate(used)[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                yield pa.record_batch(
                    [
                        pa.array(bucket[starts]),
                        pa.array([variant[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([flip[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "variants", "flips"],
                )

    def meet(variant: np.ndarray, flip: np.ndarray) -> np.ndarray:
        """Links (center, member) of one bucket, each once."""
        ordered = np.sort(variant)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            return np.zeros((0, 2), dtype=np.uint64)
        place = np.minimum(np.searchsorted(shared, variant), len(shared) - 1)
        kept = np.flatnonzero(shared[place] == variant)
        group, mask = place[kept], flips[flip[kept]]
        member = variant[kept] ^ mask
        far = np.bitwise_count(mask) > near
        order = np.lexsort((member, far, group))
        group, member, far = group[order], member[order], far[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(first, len(group)))
        center, central = np.repeat(member[first], sizes), np.repeat(~far[first], sizes)
        verified = central & (center != member) & (np.bitwise_count(center ^ member) <= max_distance)
        return np.unique(np.stack([center[verified], member[verified]], axis=1), axis=0)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def flush() -> pa.RecordBatch:
            links = meet(*(np.concatenate(part) for part in zip(*held, strict=True))).view(np.int64)
            return pa.record_batch([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["node", "other"])

        for batch in batches:
            for bucket, variants, used in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and bucket != current:
                    yield flush()
                    held = []
                current = bucket
                held.append((np.frombuffer(variants, np.uint64), np.frombuffer(used, small)))
        if held:
            yield flush()

    path = scratch_path(spark, "links")
    spread = distinct.select("fingerprint").repartition(tasks, "fingerprint")
    with shuffle_files_removed(spark):
        for turn in range(share + 1):
            packed = spread.mapInArrow(
                lambda it, turn=turn: emit(turn, it), "bucket long, variants binary, flips binary"
            )
            dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
            dealt.mapInArrow(join, "node long, other long").write.mode("append").parquet(path)
    return spark.read.schema("node long, other long").parquet(path)


def near_duplicate_groups(
    docs: DataFrame, n: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that can be reached over fingerprints of at
    most ``max_distance`` differing bits. Equal fingerprints are one node, so any number
    of copies costs one row per copy. NULL texts are empty; a NULL doc_id never names a
    group that has another id; other columns are ignored; no rows give no rows.
    """
    marked = persist_reliably(fingerprints(docs, n))
    distinct = persist_reliably(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    placed = _placed(distinct, max_distance)
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups_ = persist_reliably(placed.join(named, "root").select("fingerprint", "component_id"))
    return marked.join(groups_, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _placed(distinct: DataFrame, max_distance: int) -> DataFrame:
    """``distinct`` with ``root``, the smallest fingerprint of each one's component."""
    roots = connected_components(fingerprint_links(distinct, max_distance)).withColumnRenamed("node", "fingerprint")
    return distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def keep_one_of_each_group(docs: DataFrame, n: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group.

    Rows are judged by themselves, by id and text, so rows of one id with different texts are not
    taken for copies, and rows without an id are judged too. Of a group the row of the smallest
    doc_id stays, one without an id last, and of several such rows the one of the smallest MD5 of
    id and text; of rows equal in both one stays. Other columns stay as they are.
    """
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    marked = persist_reliably(_fingerprinted(own, n))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")
    distinct = persist_reliably(marked.groupBy("fingerprint").agg(first))
    placed = persist_reliably(_placed(distinct, max_distance))
    kept_of = placed.groupBy("root").agg(F.min("first")["_row"].alias("_kept"))
    chosen = persist_reliably(placed.join(kept_of, "root").select("fingerprint", "_kept"))
    judged = persist_reliably(marked.join(chosen, "fingerprint").select("_row", (F.col("_row") == F.col("_kept")).alias("_stays")))
    left_out = persist_reliably(judged.filter("NOT _stays").select("_row").distinct())
    repeated = persist_reliably(judged.filter("_stays").groupBy("_row").count().filter("count > 1").select("_row"))
    named = docs.withColumn("_row", key)
    kept = named.join(broadcast_if_bounded(left_out, MAX_BROADCAST_ROWS), "_row", "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = broadcast_if_bounded(repeated, MAX_BROADCAST_ROWS)
    single = kept.join(again, "_row", "left_anti").select(*docs.columns)
    double = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
    return single.unionAll(double)
