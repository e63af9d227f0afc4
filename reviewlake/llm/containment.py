"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a Jaccard similarity near zero, so signatures
of both sides would miss it. Here only the items are sketched. Items are partitioned by
size, powers of two of their shingle count. Each partition has a MinHash permutation of its
own, and an item's sketch is the bottom of its shingles under it: as many as an item of
the partition's largest size may miss, and one more. A document that contains the asked
share of an item's shingles therefore holds at least one shingle of its sketch, whatever the
document's length, and the search misses nothing. Documents probe the sketches with all
their shingles; candidates too short for the item are dropped by size, and the others are
verified by exact containment of the shingles as strings.

Items are read in blocks of a bounded number of shingles, each sent to the tasks that scan
the documents. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.text_arrays import alphanumeric, code_points, groups, mix, shingle_hashes, span_hashes, spans

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Items sent to the tasks at a time hold about this many shingles together.
BLOCK_SHINGLES = 1 << 19

PAIR_SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


@dataclass
class Words:
    """The words of a group of texts: lower-case runs of letters and digits."""

    joined: str
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        lowered = [t.lower().replace("\0", " ") for t in texts]
        points, text_starts = code_points(lowered, "\0")
        starts, ends = spans(alphanumeric()[points])
        offsets = np.searchsorted(starts, text_starts)
        return cls("\0".join(lowered), starts, ends, offsets, span_hashes(points, starts, ends))

    def shingle_set(self, text: int, n: int) -> set[str]:
        a, b = int(self.offsets[text]), int(self.offsets[text + 1])
        joined = self.joined
        words = [joined[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]
        return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


@dataclass
class Sketches:
    """One block of items. ``probes`` maps a shingle length to its sketch hashes."""

    item_ids: list[int | None]
    shingles: list[set[str]]
    lengths: list[int]
    least: list[int]
    probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def sketch_size(n_shingles: int, threshold: float) -> int:
    """How many of its shingles an item's sketch holds, by the largest size of its partition."""
    largest = 2 ** n_shingles.bit_length() - 1
    return min(n_shingles, floor((1 - threshold) * largest + 1e-9) + 1)


def make_sketches(items: list[tuple[int | None, str]], n: int, threshold: float) -> Sketches:
    """Sketches of the items; an item without words has none and is never found.

    An item of fewer than ``n`` words is one shingle, its whole sequence.
    """
    out = Sketches([], [], [], [], {})
    words = Words.of([text for _, text in items]) if items else None
    sketched: dict[int, list[tuple[int, int]]] = {}
    for i, (item_id, _) in enumerate(items):
        count = int(words.offsets[i + 1] - words.offsets[i])
        if not count:
            continue
        length = min(n, count)
        own = words.hashes[words.offsets[i] : words.offsets[i + 1]]
        hashes = np.unique(shingle_hashes(own, np.array([0, count]), length)[0])
        shingles = words.shingle_set(i, length)
        size_class = len(shingles).bit_length()
        with np.errstate(over="ignore"):
            order = np.argsort(mix(hashes + mix(np.array([size_class], dtype=np.uint64))))
        index = len(out.item_ids)
        for value in hashes[order[: sketch_size(len(shingles), threshold)]].tolist():
            sketched.setdefault(length, []).append((value, index))
        out.item_ids.append(item_id)
        out.shingles.append(shingles)
        out.lengths.append(length)
        out.least.append(ceil(threshold * len(shingles) - 1e-9))
    for length, pairs in sketched.items():
        pairs.sort()
        values = np.array([v for v, _ in pairs], dtype=np.uint64)
        filled = np.zeros(1 << 20, dtype=bool)
        filled[values >> np.uint64(44)] = True
        out.probes[length] = (values, np.array([i for _, i in pairs], dtype=np.int64), filled)
    return out


def candidates(words: Words, sketches: Sketches) -> set[tuple[int, int]]:
    """(text, item) that share a sketch shingle and could hold enough by their size."""
    found: set[tuple[int, int]] = set()
    for length, (values, owners, filled) in sketches.probes.items():
        hashes, offsets = shingle_hashes(words.hashes, words.offsets, length)
        likely = np.flatnonzero(filled[hashes >> np.uint64(44)])
        first = np.searchsorted(values, hashes[likely], side="left")
        last = np.searchsorted(values, hashes[likely], side="right")
        hits = np.flatnonzero(last > first)
        texts = np.searchsorted(offsets, likely[hits], side="right") - 1
        for text, a, b in zip(texts.tolist(), first[hits].tolist(), last[hits].tolist(), strict=True):
            size = offsets[text + 1] - offsets[text]
            found.update((text, i) for i in owners[a:b].tolist() if size >= sketches.least[i])
    return found


def verified_pairs(texts: list[str], sketches: Sketches, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shared shingles, shingles of the item) of every contained item."""
    for lo, hi in groups(texts):
        words = Words.of(texts[lo:hi])
        held: dict[tuple[int, int], set[str]] = {}
        for text, item in sorted(candidates(words, sketches)):
            key = (text, sketches.lengths[item])
            if key not in held:
                held = {key: words.shingle_set(*key)}
            shingles = sketches.shingles[item]
            shared = len(shingles & held[key])
            if shared >= threshold * len(shingles):
                yield lo + text, item, shared, len(shingles)


def _blocks(benchmark: DataFrame, n: int, threshold: float) -> Iterator[Sketches]:
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 6 + 1
        if size >= BLOCK_SHINGLES:
            yield make_sketches(held, n, threshold)
            held, size = [], 0
    if held:
        yield make_sketches(held, n, threshold)


def contained_items(
    docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE_WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items that documents contain.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. A pair is returned if at
    least ``threshold`` of the item's different ``n``-word shingles occur in the document's
    whole text. Words are runs of letters and digits in lower case. A row for each row of
    ``docs``, so repeated rows give repeated pairs; NULL and wordless texts contain nothing
    and are contained in nothing; other columns are ignored; an empty table on either side
    gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")

    def search(sketches: Sketches) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [
                    (doc_ids[row], sketches.item_ids[item], shared, size, shared / size)
                    for row, item, shared, size in verified_pairs(texts, sketches, threshold)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        return chosen.mapInArrow(run, PAIR_SCHEMA)

    parts = [search(sketches) for sketches in _blocks(items, n, threshold)]
    if not parts:
        return docs.sparkSession.createDataFrame([], PAIR_SCHEMA)
    return reduce(DataFrame.unionAll, parts)


def without_contained_items(
    docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE_WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without the rows that contain an item; nothing else changes.

    Rows are judged where they are, one pass for each block of items.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    at = docs.columns.index("text")

    def clean(rows: DataFrame, sketches: Sketches) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                found = {row for row, *_ in verified_pairs(texts, sketches, threshold)}
                yield batch.filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return reduce(clean, _blocks(items, n, threshold), docs)
