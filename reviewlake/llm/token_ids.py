"""Texts to token ids with the ``tokenizers`` library, sped up by a memo of pre-tokens.

A byte-level BPE never merges across pre-tokens, so a pre-token's ids do not depend on
its neighbours. Texts are cut into pre-tokens with numpy, ids of known ones come from a
dictionary, and each new one is encoded once by the library. A tokenizer file with any
other pipeline, and a text with a character whose class differs between Unicode
versions or with the content of an added token, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.text_arrays import GROUP_CHARS, code_points, groups, span_hashes

# Fixed values of the byte-level pre-tokenizer: white space and English contractions.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_OTHER, _LETTER, _NUMBER, _SPACE, _UNSTABLE, _EDGE = range(6)
MEMO_WORDS = 600_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pre-tokenizer's class of every code point."""
    kinds = np.full(0x110000, _UNSTABLE, dtype=np.uint8)
    by_letter = {"L": _LETTER, "N": _NUMBER}
    old = unicodedata.ucd_3_2_0.category
    for point in range(0x110000):
        now = unicodedata.category(chr(point))[0]
        if now == old(chr(point))[0]:
            kinds[point] = by_letter.get(now, _OTHER)
    kinds[SPACES] = _SPACE
    kinds[0] = _EDGE
    return kinds


def pre_token_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts that are each followed by one NUL.

    A run of letters, of numbers or of other signs is one pre-token and takes one space
    before it along. Of white space before a text's next sign all but the last character
    stay together. A contraction after an apostrophe is a pre-token.
    """
    previous = np.concatenate(([_EDGE], kinds[:-1]))
    following = np.concatenate((kinds[1:], [_EDGE]))
    space = kinds == _SPACE
    after_blank = np.concatenate(([False], points[:-1] == 32))
    word_start = (kinds != previous) & ~after_blank
    space_start = (previous != _SPACE) | ((following != _SPACE) & (following != _EDGE))
    starts = np.where(space, space_start, word_start)
    starts[kinds == _EDGE] = True
    starts[np.flatnonzero(kinds[:-1] == _EDGE) + 1] = True
    quotes = np.flatnonzero((points == 39) & starts & (following == _LETTER))
    for i in quotes:
        tail = points[i + 1 : i + 3]
        for ending in CONTRACTIONS:
            if len(tail) >= len(ending) and all(tail[k] == ord(c) for k, c in enumerate(ending)):
                end = i + 1 + len(ending)
                starts[i + 1 : end] = False
                if kinds[end] == _LETTER or kinds[end] != _EDGE:
                    starts[end] = True if kinds[end] != _SPACE else starts[end]
                break
    return np.flatnonzero(starts)


class WordMemo:
    """Ids of known pre-tokens in an open-addressing table, looked up for many at once.

    A pre-token is known by two independent 64-bit hashes.
    """

    def __init__(self, dtype: np.dtype, words: int):
        self.dtype = dtype
        self.clear(words)

    def clear(self, words: int) -> None:
        """Forget all; from now on hold up to ``words`` pre-tokens."""
        self.words = words
        slots = 1 << (3 * words).bit_length()
        self.last = slots - 1
        self.key = np.zeros(slots, dtype=np.uint64)
        self.check = np.zeros(slots, dtype=np.uint64)
        self.place = np.full(slots, -1, dtype=np.int32)
        self.start = np.zeros(self.words, dtype=np.int64)
        self.length = np.zeros(self.words, dtype=np.int64)
        self.ids = np.zeros(4 * self.words, dtype=self.dtype)
        self.count, self.used = 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each pre-token, or -1."""
        slot = (key & np.uint64(self.last)).astype(np.int64)
        found = np.where((self.key[slot] == key) & (self.check[slot] == check), self.place[slot], -1)
        left = np.flatnonzero((found < 0) & (self.place[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            here = slot[left]
            hit = (self.key[here] == key[left]) & (self.check[here] == check[left])
            found[left[hit]] = self.place[here][hit]
            left = left[~hit & (self.place[here] >= 0)]
        return found

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """Add pre-tokens that have no entry yet."""
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        entries = np.arange(self.count, self.count + len(ids), dtype=np.int32)
        slot = (key & np.uint64(self.last)).astype(np.int64)
        left = np.arange(len(ids))
        while len(left):
            free = left[self.place[slot[left]] < 0]
            self.place[slot[free]] = entries[free]
            left = left[self.place[slot[left]] != entries[left]]
            slot[left] = (slot[left] + 1) & self.last
        self.key[slot], self.check[slot] = key, check
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=int(length.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(flat), dtype=self.dtype)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[entries] = self.used + np.cumsum(length) - length
        self.length[entries] = length
        self.used += len(flat)
        self.count += len(ids)


class IdEncoder:
    """Ids of whole texts, ``end_id`` (if any) after each.

    Special tokens that a text spells out stay text, or get their own ids with
    ``match_special``, which is the library's default and what the operators use.
    """

    def __init__(self, path: str, end_id: int | None, memo_words: int = MEMO_WORDS, match_special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        step = spec["pre_tokenizer"] or {}
        self.by_words = (
            spec["normalizer"] is None
            and step.get("type") == "ByteLevel"
            and not step.get("add_prefix_space")
            and step.get("use_regex", True)
            and spec["model"]["type"] == "BPE"
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not match_special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if match_special or not t.special]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = [] if end_id is None else [end_id]
        self.memo = WordMemo(self.dtype, memo_words)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one entry more than texts)."""
        parts = [self._group(texts[lo:hi]) for lo, hi in groups(texts)]
        lengths = np.concatenate([[0], *(np.diff(offsets) for _, offsets in parts)])
        ids = np.concatenate([np.zeros(0, dtype=self.dtype), *(ids for ids, _ in parts)])
        return ids, np.cumsum(lengths)

    def _library(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        rows = [np.array(e.ids + self.end, dtype=self.dtype) for e in encoded]
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def _group(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            return self._library(texts)
        points, text_starts = code_points(texts, "\0")
        kinds = _classes()[points]
        odd = (kinds == _UNSTABLE) | (kinds == _EDGE)
        odd[text_starts[1:] - 1] = False
        added = np.array([any(a in t for a in self.added) for t in texts])
        if not odd.any() and not added.any():
            return self._words(texts, points, kinds, text_starts)
        hard = added | (np.add.reduceat(odd, text_starts[:-1]) > 0)
        if hard.all():
            return self._library(texts)
        sides = {True: self._library([t for t, h in zip(texts, hard, strict=True) if h])}
        sides[False] = self._group([t for t, h in zip(texts, hard, strict=True) if not h])
        seen, rows = {True: 0, False: 0}, []
        for h in hard.tolist():
            ids, offsets = sides[h]
            rows.append(ids[offsets[seen[h]] : offsets[seen[h] + 1]])
            seen[h] += 1
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def _words(self, texts, points, kinds, text_starts) -> tuple[np.ndarray, np.ndarray]:
        starts = pre_token_starts(points, kinds)
        ends = np.append(starts[1:], len(points))
        key = span_hashes(points, starts, ends)
        check = span_hashes(points, starts, ends, second=True)
        memo = self.memo
        entry = memo.find(key, check)
        if (entry < 0).any():
            new = self._unknown(entry, key)
            if memo.count + len(new) > memo.words:
                new = self._unknown(np.full(len(key), -1), key)
                memo.clear(max(memo.words, len(new)))
            whole = "\0".join(texts) + "\0"
            memo.add(key[new], check[new], self._word_ids([whole[starts[i] : ends[i]] for i in new]))
            entry = memo.find(key, check)
        length = memo.length[entry]
        until = np.cumsum(length)
        from_ = np.repeat(memo.start[entry] - until + length, length)
        ids = memo.ids[from_ + np.arange(len(from_))]
        first = np.searchsorted(starts, text_starts)
        return ids, np.concatenate(([0], until))[first]

    @staticmethod
    def _unknown(entry: np.ndarray, key: np.ndarray) -> np.ndarray:
        """One place of each pre-token without an entry."""
        missing = np.flatnonzero(entry < 0)
        return missing[np.unique(key[missing], return_index=True)[1]]

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids from the library's model; a NUL stands for the end of a text."""
        tokenize = self.model.tokenize
        mapped = "\0".join("" if w == "\0" else w for w in words)
        split = mapped.encode().decode("latin-1").translate(_byte_signs()).split(_byte_signs()[0])
        return [[t.id for t in tokenize(w)] if w else self.end for w in split]


@lru_cache(maxsize=1)
def _byte_signs() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable sign: its own, or one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = None) -> IdEncoder:
    """One encoder for each Python worker."""
    return IdEncoder(path, end_id, match_special=True)


def with_token_ids(docs: DataFrame, tokenizer: str, end_id: int | None, group: str | None = None) -> DataFrame:
    """(doc_id, group, task, start_in_task, n_tokens, ids) of every row's whole text.

    ``ids`` holds little-endian ids of the tokenizer's width, ``end_id`` last. NULL texts
    are empty. ``task`` numbers the tasks and ``start_in_task`` counts the ids that the
    same task has given to the same group before, so places in a group's queue need no
    shuffle of the rows. Read the result from storage: it must not be computed twice.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col(group) if group else F.lit("")).cast("string").alias("group"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        task, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            for lo, hi in groups(texts, 4 * GROUP_CHARS):
                ids, offsets = encode.encode(texts[lo:hi])
                counts = np.diff(offsets)
                starts = []
                for name, count in zip(names[lo:hi], counts.tolist(), strict=True):
                    starts.append(given.get(name, 0))
                    given[name] = starts[-1] + count
                yield pa.record_batch(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(1)[lo:hi],
                        pa.array(np.full(hi - lo, task, dtype=np.int32)),
                        pa.array(starts, pa.int64()),
                        pa.array(counts),
                        binary_rows(ids, offsets),
                    ],
                    names=["doc_id", "group", "task", "start_in_task", "n_tokens", "ids"],
                )

    schema = "doc_id long, group string, task int, start_in_task long, n_tokens long, ids binary"
    return chosen.mapInArrow(run, schema)


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each range of ``values``."""
    places = pa.py_buffer((np.asarray(offsets) * values.dtype.itemsize).astype(np.int64))
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, places, data]).cast(pa.binary())


def id_width(tokenizer: str) -> np.dtype:
    return encoder(tokenizer).dtype
