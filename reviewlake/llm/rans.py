"""Token-id files coded with a static range asymmetric numeral system (rANS).

A dataset is a folder with two Parquet tables. ``frequencies`` (id, frequency) is the
one table that all blocks share: the ids' counts over the whole corpus, scaled to a sum
of ``2**SCALE_BITS`` with at least 1 for each id that occurs. ``blocks`` (shard, block,
first_id, n_ids, n_docs, payload) holds one row per block. A block codes whole documents
in ascending doc_id order and can be decoded with nothing but the shared table.

Inside a block ``lanes`` coders run interleaved: id ``i`` belongs to lane ``i % lanes``,
and the lanes' 32-bit words share one stream. Every ``CHECKPOINT_STEPS`` steps a
checkpoint keeps the lanes' states, the place in the stream and a CRC-32 of the ids up to
the next one, so that the parts of a large block can be decoded apart and each is
checked. ``blocks`` is written by Spark: a lost executor's shard is written again from the
stored ids, and readers see complete files only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.llm.offsets import running_start
from reviewlake.llm.staging import staged
from reviewlake.llm.token_ids import id_width, with_token_ids

MAGIC = b"RANSIDS1"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 19
BLOCK_DOCS = 1 << 16
SHARD_IDS = 1 << 22

_HEADER = struct.Struct("<8sIIIIQI")


@dataclass
class Frequencies:
    """Scaled frequency, and sum of the frequencies before it, of each id."""

    frequency: np.ndarray
    before: np.ndarray
    checksum: int
    _symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The id of each of the ``2**SCALE_BITS`` slots."""
        if self._symbols is None:
            kind = np.uint16 if len(self.frequency) <= 1 << 16 else np.uint32
            self._symbols = np.repeat(np.arange(len(self.frequency), dtype=kind), self.frequency.astype(np.int64))
        return self._symbols


def scaled_frequencies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of the ids that sum to ``2**SCALE_BITS``, none of them zero.

    What rounding leaves over or takes too much is settled with the most frequent ids,
    ties by the smaller id.
    """
    total = 1 << SCALE_BITS
    if len(ids) > total:
        raise ValueError(f"{len(ids)} different ids; a frequency table holds {total}")
    whole = int(counts.sum())
    scaled = np.array([max(1, int(c) * total // whole) for c in counts], dtype=np.int64)
    order = np.lexsort((ids, -counts))
    short = total - int(scaled.sum())
    if short > 0:
        scaled[order[0]] += short
    for i in order:
        if short >= 0:
            break
        taken = min(-short, int(scaled[i]) - 1)
        scaled[i] -= taken
        short += taken
    return scaled


def frequency_table(ids: np.ndarray, scaled: np.ndarray) -> Frequencies:
    size = int(ids.max()) + 1 if len(ids) else 1
    frequency = np.zeros(size, dtype=np.uint64)
    frequency[ids] = scaled
    before = np.cumsum(frequency) - frequency
    return Frequencies(frequency, before, zlib.crc32(frequency.astype("<u4").tobytes()))


def encode_block(
    ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, table: Frequencies, lanes: int = LANES
) -> bytes:
    """One self-contained block; ``lengths`` are the documents' numbers of ids.

    ``doc_ids`` is a masked or plain array; a NULL doc_id is stored as such.
    """
    lanes = max(1, min(lanes, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    frequency, before = table.frequency[ids], table.before[ids]
    limit = frequency << np.uint64(63 - SCALE_BITS)
    words: list[np.ndarray] = []
    checkpoints: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, len(ids))
        x, f = state[: b - a], frequency[a:b]
        full = np.flatnonzero(x >= limit[a:b])
        if len(full):
            words.append(x[full].astype("<u4"))
            x[full] >>= np.uint64(32)
            written += len(full)
        q = x // f
        x[:] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + before[a:b]
        if step % CHECKPOINT_STEPS == 0:
            checkpoints.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    ids4 = ids.astype("<u4")
    parts = []
    for k, (left, states) in enumerate(checkpoints[::-1]):
        part = ids4[k * CHECKPOINT_STEPS * lanes : (k + 1) * CHECKPOINT_STEPS * lanes]
        parts.append(struct.pack("<II", written - left, zlib.crc32(part.tobytes())) + states.astype("<u8").tobytes())
    known = ~np.ma.getmaskarray(np.ma.asarray(doc_ids))
    directory = known.astype("<u1").tobytes() + np.ma.filled(doc_ids, 0).astype("<i8").tobytes()
    directory += np.asarray(lengths).astype("<i8").tobytes()
    head = _HEADER.pack(MAGIC, table.checksum, lanes, len(parts), len(lengths), len(ids), len(stream))
    body = head + directory + b"".join(parts) + stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Block:
    """A block's directory and coded parts, before decoding."""

    lanes: int
    n_ids: int
    doc_ids: np.ma.MaskedArray
    lengths: np.ndarray
    checkpoints: list[tuple[int, int, np.ndarray]]
    stream: np.ndarray


def open_block(payload: bytes, table: Frequencies) -> Block:
    """Check and split a payload; raises ValueError if it is damaged or of another table."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block: the checksum of the payload differs")
    magic, checksum, lanes, n_parts, n_docs, n_ids, n_words = _HEADER.unpack_from(payload)
    if magic != MAGIC or checksum != table.checksum:
        raise ValueError("not a block of this frequency table")
    at = _HEADER.size
    known = np.frombuffer(payload, "<u1", n_docs, at).astype(bool)
    doc_ids = np.ma.masked_array(np.frombuffer(payload, "<i8", n_docs, at + n_docs), mask=~known)
    lengths = np.frombuffer(payload, "<i8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    checkpoints = []
    for _ in range(n_parts):
        place, crc = struct.unpack_from("<II", payload, at)
        checkpoints.append((place, crc, np.frombuffer(payload, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return Block(lanes, n_ids, doc_ids, lengths, checkpoints, np.frombuffer(payload, "<u4", n_words, at))


def decode_part(block: Block, part: int, table: Frequencies) -> np.ndarray:
    """The ids from one checkpoint to the next; needs no other part."""
    lanes, symbols = block.lanes, table.symbols
    first = part * CHECKPOINT_STEPS * lanes
    last = min(block.n_ids, first + CHECKPOINT_STEPS * lanes)
    place, crc, states = block.checkpoints[part]
    state, out = states.astype(np.uint64), np.empty(last - first, dtype="<u4")
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for a in range(first, last, lanes):
        b = min(a + lanes, last)
        x = state[: b - a]
        slot = x & mask
        ids = symbols[slot]
        x[:] = table.frequency[ids] * (x >> np.uint64(SCALE_BITS)) + slot - table.before[ids]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | block.stream[place : place + len(low)]
            place += len(low)
        out[a - first : b - first] = ids
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError(f"damaged block: the checksum of part {part} differs")
    return out


def decode_block(payload: bytes, table: Frequencies) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a block."""
    block = open_block(payload, table)
    parts = [decode_part(block, k, table) for k in range(len(block.checkpoints))]
    return block.doc_ids, block.lengths, np.concatenate([np.zeros(0, dtype="<u4"), *parts])


def _count_ids(batches: Iterator[pa.RecordBatch], width: np.dtype) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, dtype=np.int64)
    for batch in batches:
        values = np.concatenate([np.zeros(0, width), *(np.frombuffer(x, width) for x in batch.column(0).to_pylist())])
        more = np.bincount(values, minlength=len(counts))
        more[: len(counts)] += counts
        counts = more
    ids = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(counts[ids].astype(np.int64))], names=["id", "n"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None) -> None:
    """Write the ids of all rows of ``docs`` (doc_id, text) under ``path``.

    NULL texts are empty; rows with equal doc_id stay, in the order of their ids; a NULL
    doc_id comes first; other columns are ignored. Texts are encoded once and stored,
    counted, dealt to shards by doc_id range, and each shard is coded as a stream.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer)
    stored = staged(with_token_ids(docs, tokenizer, end_id).select("doc_id", "n_tokens", "ids"))
    counted = stored.select("ids").mapInArrow(lambda it: _count_ids(it, width), "id long, n long")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, counts = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    scaled = scaled_frequencies(ids, counts) if len(ids) else counts
    pairs = list(zip(ids.tolist(), scaled.tolist(), strict=True))
    spark.createDataFrame(pairs, "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    table = frequency_table(ids, scaled)
    shards = max(1, -(-int(counts.sum()) // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.ma.masked_array([d or 0 for d, _ in held], mask=[d is None for d, _ in held], dtype="<i8")
            lengths = np.array([len(x) for _, x in held], dtype=np.int64)
            payload = encode_block(np.concatenate([x for _, x in held]), names, lengths, table)
            values = [[shard], [block], [first], [size], [len(held)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            return pa.record_batch(columns, names=["shard", "block", "first_id", "n_ids", "n_docs", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(ids, width)
                if held and (size + len(values) > BLOCK_IDS or len(held) == BLOCK_DOCS):
                    yield flush()
                    held, block, first, size = [], block + 1, first + size, 0
                held.append((doc_id, values))
                size += len(values)
        if held:
            yield flush()

    ordered = stored.select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    schema = "shard int, block int, first_id long, n_ids long, n_docs long, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str, kind: str, make: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()
    table = frequency_table(rows["id"].to_numpy(np.int64), rows["frequency"].to_numpy(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc_ids, lengths, ids = decode_block(payload, table)
                ends = np.cumsum(lengths)
                yield pa.record_batch(
                    [
                        pa.array([shard] * len(lengths), pa.int32()),
                        pa.array(doc_ids.data, mask=np.ma.getmaskarray(doc_ids)),
                        pa.array(first + ends - lengths),
                        pa.array(lengths),
                        make([ids[a:b] for a, b in zip(ends - lengths, ends, strict=True)]),
                    ],
                    names=["shard", "doc_id", "in_shard", "n_tokens", "value"],
                )

    schema = f"shard int, doc_id long, in_shard long, n_tokens long, value {kind}"
    read = blocks.select("shard", "first_id", "payload").mapInArrow(run, schema)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    starts = running_start(totals, "shard", "n_ids", "shard_start").select("shard", "shard_start")
    placed = read.join(starts, "shard")
    return placed.select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "value")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    made = _read(spark, path, "array<int>", lambda rows: pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())))
    return made.withColumnRenamed("value", "ids")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): decoded ids, digested in the reading tasks."""
    made = _read(spark, path, "long", lambda rows: pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()))
    return made.withColumnRenamed("value", "ids_crc32")
