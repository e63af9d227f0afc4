"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids. Every window of ``window`` tokens is filled
to the sources' target shares: a source's deficit grows by its share of each window, the
round serves whole grains from each queue as far as its deficit allows, and what rounding
leaves open goes to the largest deficits. The rest is carried to the next window. Windows
come in blocks, and a block is the unit that a task can compute alone: what each source
has been served before a block follows from its weight (the order of virtual finishing
times, grain by grain), so its deficits on entry are known without running the blocks
before. All arithmetic on one block takes the same path wherever it runs.

Queues are never gathered. A task numbers its own ids per source when it encodes them
(``with_token_ids``), one small table adds up the tasks, and each document then finds its
windows from its place in its queue. Neither ids nor texts are shuffled.

Of very many sources the small ones are dealt to shared queues. Within a shared queue the
grains of its sources come in the order of their virtual finishing times, so each source has
its share of the queue as the queue has its share of the windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reviewlake.llm.staging import staged
from reviewlake.llm.token_ids import binary_rows, id_width, with_token_ids
from reviewlake.session import broadcast_if_bounded, persist_reliably

WINDOW = 2048
GRAIN = 64
BLOCK_WINDOWS = 256
#: From this many sources on, half of the queues are shared by the smaller sources.
MAX_QUEUES = 4096
MAX_BROADCAST_ROWS = 1_000_000
#: A task keeps the blocks it has computed up to this many (window, queue) cells.
CACHED_CELLS = 1 << 21
#: Cells (grain, source) of a shared queue that are compared at once.
COMPARED_CELLS = 1 << 20

_NULL_SOURCE = "\0"

PIECE_SCHEMA = (
    "doc_id long, source string, start long, length long, ids binary, ids_crc32 long, "
    "doc_tokens long, sequence_id long, offset long"
)
PIECE_COLUMNS = [part.split()[0] for part in PIECE_SCHEMA.split(", ")]


@dataclass
class Plan:
    """Where each id of each queue goes. ``tokens`` and ``weights`` are per queue."""

    tokens: np.ndarray
    weights: np.ndarray
    window: int = WINDOW
    grain: int = GRAIN
    block_windows: int = BLOCK_WINDOWS
    _blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    _last: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.grains = self.tokens // self.grain
        self.total_grains = int(self.grains.sum())
        self.per_window = self.window // self.grain
        # Less than a grain is left of each queue; these tails follow the last grain.
        tails = self.tokens - self.grains * self.grain
        self.tail_start = self.total_grains * self.grain + np.cumsum(tails) - tails

    def _count(self, time: float) -> np.ndarray:
        """Grains of each queue whose virtual finishing time ``(k + 1/2) / weight`` is past."""
        return np.minimum(np.floor(time * self.weights + 0.5), self.grains).astype(np.int64)

    def served_before(self, block: int) -> np.ndarray:
        """Grains that each queue has given when ``block`` begins."""
        goal = min(block * self.block_windows * self.per_window, self.total_grains)
        low, high = 0.0, float(((self.grains + 1) / self.weights).max(initial=1.0))
        if goal >= self.total_grains:
            return self.grains.copy()
        while (middle := (low + high) / 2) not in (low, high):
            if int(self._count(middle).sum()) <= goal:
                low = middle
            else:
                high = middle
        served, following = self._count(low), self._count(high)
        short = goal - int(served.sum())
        room = np.cumsum(following - served)
        return served + np.clip(short - (room - (following - served)), 0, following - served)

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Deficit round-robin in one block.

        Returns, with a row for each window and one more, the grains each queue has given
        before it, and for each window where each queue's grains begin in it.
        """
        if number not in self._blocks:
            if len(self._blocks) * self.block_windows * len(self.tokens) >= CACHED_CELLS:
                self._blocks.clear()
            self._blocks[number] = self._run(number)
        return self._blocks[number]

    def _run(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.served_before(number), self.served_before(number + 1)
        left = end - start
        grains = int(left.sum())
        windows = -(-grains // self.per_window)
        # The carried deficits: what the shares give up to here, less what was served.
        deficit = (start.sum() * self.weights / self.weights.sum() - start).clip(-1, 1)
        served = np.zeros((windows + 1, len(left)), dtype=np.int64)
        places = np.zeros((windows, len(left)), dtype=np.int64)
        served[0] = start
        for w in range(windows):
            room = min(self.per_window, int(left.sum()))
            share = np.where(left > 0, self.weights, 0.0)
            deficit = deficit + share * (room / share.sum())
            turn = np.minimum(np.floor(np.maximum(deficit, 0)).astype(np.int64), left)
            over = int(turn.sum()) - room
            for queue in np.argsort(deficit - turn, kind="stable") if over > 0 else ():
                taken = min(over, int(turn[queue]))
                turn[queue] -= taken
                over -= taken
                if not over:
                    break
            while (short := room - int(turn.sum())) > 0:
                open_ = np.flatnonzero(left > turn)
                first = open_[np.argsort(turn[open_] - deficit[open_], kind="stable")][:short]
                turn[first] += 1
            deficit = deficit - turn
            left = left - turn
            served[w + 1] = served[w] + turn
            places[w] = np.cumsum(turn) - turn
        return served, places

    def _block_of(self, queue: int, grain: int) -> int:
        """The block that serves a queue's grain; mostly that of the document before."""
        last = self._last.get(queue, 0)
        for near in (last, last + 1):
            served = self.block(near)[0]
            if served[0, queue] <= grain < served[-1, queue]:
                return near
        low, high = 0, self.total_grains // (self.block_windows * self.per_window) + 1
        while low < high:
            middle = (low + high) // 2
            if int(self.served_before(middle + 1)[queue]) > grain:
                high = middle
            else:
                low = middle + 1
        return low

    def pieces(self, queue: int, begin: int, end: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the queue's ids from ``begin`` to ``end``.

        ``start`` counts from ``begin``. The pieces are in order and leave nothing out.
        """
        out: list[tuple[int, int, int, int]] = []
        at, main = begin, int(self.grains[queue]) * self.grain
        block = self._block_of(queue, at // self.grain) if at < min(end, main) else 0
        while at < min(end, main):
            served, places = self.block(block)
            column = served[:, queue] * self.grain
            w = int(np.searchsorted(column, at, side="right")) - 1
            while w < len(places) and at < min(end, main):
                until = min(end, main, int(column[w + 1]))
                if until > at:
                    offset = int(places[w, queue]) * self.grain + at - int(column[w])
                    out.append((at - begin, until - at, block * self.block_windows + w, offset))
                    at = until
                w += 1
            self._last[queue] = block
            block += 1
        while at < end:
            place = int(self.tail_start[queue]) + at - main
            sequence, offset = divmod(place, self.window)
            until = min(end, at + self.window - offset)
            out.append((at - begin, until - at, sequence, offset))
            at = until
        return out


class SharedQueue:
    """Where the ids of each source of a shared queue stand in it.

    Grain ``k`` of a source is due at ``(k + 1/2) / tokens``; the grains of all sources are
    in the order of these times, equal times in the order of the sources. What is left of
    each source, less than a grain, follows the last grain.
    """

    def __init__(self, tokens: np.ndarray, grain: int = GRAIN):
        self.grain = grain
        self.weights = tokens.astype(np.float64)
        self.grains = tokens // grain
        tails = tokens - self.grains * grain
        self.tail_start = int(self.grains.sum()) * grain + np.cumsum(tails) - tails

    def _ranks(self, member: int, first: int, last: int) -> np.ndarray:
        """How many grains of the queue come before each of the source's grains."""
        due = ((np.arange(first, last) + 0.5) / self.weights[member])[:, None]
        count = np.clip(np.ceil(due * self.weights - 0.5), 0, self.grains).astype(np.int64)
        # The rounded product may be off by one; the times themselves decide.
        count -= (count > 0) & ((count - 0.5) / self.weights >= due)
        following = (count + 0.5) / self.weights
        count += (count < self.grains) & (following < due)
        ties = (count < self.grains) & ((count + 0.5) / self.weights == due)
        ties[:, member:] = False
        return (count + ties).sum(axis=1)

    def pieces(self, member: int, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(start, length, place in the queue) of the source's ids; ``start`` counts from ``begin``."""
        out: list[tuple[int, int, int]] = []
        main = int(self.grains[member]) * self.grain
        until, step = min(end, main), max(1, COMPARED_CELLS // len(self.grains))
        last = -(-until // self.grain)
        for first in range(begin // self.grain, last, step):
            for k, rank in enumerate(self._ranks(member, first, min(first + step, last)).tolist(), first):
                low, high = max(begin, k * self.grain), min(until, (k + 1) * self.grain)
                out.append((low - begin, high - low, rank * self.grain + low - k * self.grain))
        if end > max(begin, main):
            low = max(begin, main)
            out.append((low - begin, end - low, int(self.tail_start[member]) + low - main))
        return out


def _pieces_by_time(plan: Plan, shared: dict[int, SharedQueue], keys: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """The pieces of many rows (queue, begin, count, member).

    Grains are looked up in the order in which the blocks serve them, so no block is
    computed twice although few of them are kept.
    """
    grains = []
    for row, (queue, begin, count, member) in enumerate(keys.T.tolist()):
        if member >= 0:
            spans = shared[queue].pieces(member, begin, begin + count)
        else:
            edges = [begin, *range((begin // plan.grain + 1) * plan.grain, begin + count, plan.grain), begin + count]
            spans = [(low - begin, high - low, low) for low, high in zip(edges, edges[1:]) if high > low]
        grains += [(place, queue, row, start, length) for start, length, place in spans]
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(keys.shape[1])]
    recent = 0
    for place, queue, row, start, length in sorted(grains, key=lambda g: (g[0] // plan.grain + 0.5) / plan.weights[g[1]]):
        plan._last[queue] = recent
        for at, size, sequence, offset in plan.pieces(queue, place, place + length):
            found[row].append((start + at, size, sequence, offset))
        recent = plan._last[queue]
    merged: list[list[tuple[int, int, int, int]]] = []
    for pieces in found:
        out: list[tuple[int, int, int, int]] = []
        for piece in sorted(pieces):
            last = out[-1] if out else None
            if last and last[2] == piece[2] and last[3] + last[1] == piece[3]:
                out[-1] = (last[0], last[1] + piece[1], *last[2:])
            else:
                out.append(piece)
        merged.append(out)
    return merged


def _queues(
    totals: DataFrame, weights: Mapping[str, float] | None, max_queues: int
) -> tuple[DataFrame, Plan, dict[int, SharedQueue]]:
    """The queue, member and first place of each (group, task), the plan, and the shared queues.

    ``totals`` is stored: (group, task, n). ``member`` is the source's number in a shared
    queue, -1 in a queue of its own.
    """
    spark = totals.sparkSession
    by_source = totals.groupBy("group").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
    largest = [r["group"] for r in by_source.orderBy(F.desc("n"), "group").limit(max_queues).collect()]
    share_out = max(1, max_queues // 2) if len(largest) >= max_queues else 0
    own = set(largest[: max_queues - share_out])
    if share_out and weights:
        given = spark.createDataFrame([(_NULL_SOURCE if g is None else g,) for g in weights], "group string")
        own |= {r["group"] for r in by_source.join(F.broadcast(given), "group", "left_semi").collect()}
    names = sorted(own)
    known = spark.createDataFrame([(g, i, -1) for i, g in enumerate(names)], "group string, queue int, member int")
    groups_ = known
    if share_out:
        rest = by_source.join(F.broadcast(known), "group", "left_anti").withColumn(
            "queue", (F.pmod(F.xxhash64("group"), F.lit(share_out)) + len(names)).cast("int")
        )
        number = F.row_number().over(Window.partitionBy("queue").orderBy("group")) - 1
        groups_ = known.unionByName(rest.select("group", "queue", number.alias("member")))
    groups_ = persist_reliably(groups_)
    # The last queue is that of sources without any id.
    queued = totals.join(broadcast_if_bounded(groups_, MAX_BROADCAST_ROWS), "group", "left").withColumns(
        {"queue": F.coalesce("queue", F.lit(len(names) + share_out)), "member": F.coalesce("member", F.lit(-1))}
    )
    before = Window.partitionBy("queue", "member").orderBy("task", "group").rowsBetween(Window.unboundedPreceding, -1)
    placed = persist_reliably(queued.withColumn("queue_start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    tokens = np.zeros(len(names) + share_out + 1, dtype=np.int64)
    sums = placed.groupBy("queue", "member").agg(F.sum("n").alias("n")).toArrow()
    queue, member, n = (sums.column(c).to_numpy().astype(np.int64) for c in ("queue", "member", "n"))
    np.add.at(tokens, queue, n)
    order = np.lexsort((member, queue))
    order = order[member[order] >= 0]
    edges = np.flatnonzero(np.diff(queue[order])) + 1
    shared = {int(queue[part[0]]): SharedQueue(n[part]) for part in np.split(order, edges) if len(part)}
    if weights is None:
        share = tokens.astype(np.float64)
    else:
        named = [weights.get(None if g == _NULL_SOURCE else g, 0.0) for g in names]
        share = np.array([*named, *[0.0] * (share_out + 1)], dtype=np.float64)
    # A queue without a target comes as late as possible; nothing is left out.
    least = share[share > 0].min(initial=1.0)
    return placed.drop("n"), Plan(tokens, np.where(share > 0, share, least * 1e-9)), shared


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None,
    weights: Mapping[str, float] | None = None,
    max_queues: int = MAX_QUEUES,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack the ids of all rows of ``docs`` (doc_id, text, source) into windows.

    Returns one row per piece: (doc_id, source, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset); ``ids`` are little-endian bytes of the tokenizer's width, NULL
    without ``keep_ids``, and the CRC-32 is that of 32-bit ids. Each id is in exactly one
    piece, and all windows but the last are full. ``weights`` are target
    shares of the sources; by default each source's share of all tokens, so that all queues
    end together. With other weights a queue that has run out stops taking part and the
    others share its part. From ``max_queues`` sources on, the smaller ones without a given
    weight are dealt to shared queues and keep their shares of them. NULL texts are empty, NULL is a source like any other, and rows with equal doc_id are packed each.
    An empty table gives no rows.
    """
    chosen = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit(_NULL_SOURCE)).alias("source"))
    stored = staged(with_token_ids(chosen, tokenizer, end_id, group="source"))
    totals = persist_reliably(stored.groupBy("group", "task").agg(F.sum("n_tokens").alias("n")))
    starts, plan, shared = _queues(totals, weights, max_queues)
    width = id_width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(5).to_pylist()
            keys = np.array([batch.column(k).to_numpy() for k in (2, 3, 4, 6)], dtype=np.int64)
            rows, chunks, columns = [], [], []
            by_time = _pieces_by_time(plan, shared, keys) if shared else None
            for row in np.lexsort(keys[1::-1]).tolist():
                queue, begin, count = keys[:3, row].tolist()
                places = by_time[row] if shared else plan.pieces(queue, begin, begin + count)
                ids = np.frombuffer(ids_of[row], width)
                for start, length, sequence, offset in places:
                    piece = ids[start : start + length]
                    rows.append(row)
                    chunks.append(piece if keep_ids else piece[:0])
                    columns.append((start, length, zlib.crc32(piece.astype("<u4").tobytes()), sequence, offset))
            if not rows:
                continue
            start, length, crc, sequence, offset = (pa.array(c) for c in np.array(columns, dtype=np.int64).T)
            taken = pa.array(rows)
            kept = binary_rows(np.concatenate(chunks), np.concatenate(([0], np.cumsum([len(c) for c in chunks]))))
            yield pa.record_batch(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    start,
                    length,
                    kept if keep_ids else pa.nulls(len(rows), pa.binary()),
                    crc,
                    batch.column(4).take(taken),
                    sequence,
                    offset,
                ],
                names=PIECE_COLUMNS,
            )

    placed = stored.join(broadcast_if_bounded(starts, MAX_BROADCAST_ROWS), ["group", "task"]).select(
        "doc_id",
        F.when(F.col("group") != _NULL_SOURCE, F.col("group")).alias("source"),
        "queue",
        (F.col("queue_start") + F.col("start_in_task")).alias("begin"),
        "n_tokens",
        "ids",
        "member",
    )
    return placed.mapInArrow(run, PIECE_SCHEMA)
