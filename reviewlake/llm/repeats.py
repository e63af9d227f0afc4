"""Removal of word passages that an earlier document holds, by suffix automata.

A window is ``window`` consecutive words; a word goes if a window that covers it also stands in a
document with a smaller id. Reference text is cut into shards, each shard is one suffix automaton
whose states know the smallest document that holds their words, and documents stream over the
automata: the matching statistics tell for each of their windows whether, and where first, it
occurs.

Sending every automaton to every document would cost the square of the corpus. Shards are
therefore made by content. The *anchor* of a window is the least hash of its ``ANCHOR_WORDS``-word
sequences, so equal windows have equal anchors and meet in the anchor's shard, whichever documents
they come from. Four jobs run over a stored copy of the texts, dealt to blocks of bounded size:

1. Blocks send their anchors, each once, and learn which occur in two documents.
2. Runs of windows with such anchors are sent to the anchors' shards, each different run of a block
   once. An anchor with more than ``HOT`` occurrences is dealt by whole windows instead.
3. A shard builds automata of at most ``AUTOMATON_WORDS`` words (or one anchor's runs) from the
   different runs, streams all of them, and answers the blocks.
4. Blocks mark the covered words.

Words are compared by 48-bit hashes of their bytes, so two different windows are taken for equal
only if every word in which they differ collides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.simhash import shuffle_files_removed
from reviewlake.llm.staging import staged
from reviewlake.llm.text_arrays import mix, span_hashes

WINDOW = 13
ANCHOR_WORDS = 5
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of anchors and each shard of runs.
BUCKET_BYTES = 32 << 20
SHARD_BYTES = 16 << 20
#: Bytes of text whose words are hashed at a time.
CHUNK_BYTES = 1 << 20
AUTOMATON_WORDS = 100_000
HOT = 1 << 14
#: Longer runs of windows with one anchor are cut.
MAX_RUN = 64
#: A word's hash is sent in so many bytes.
WORD_BYTES = 6
#: Stands for a NULL doc_id: later than all others.
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"

_U64 = np.uint64
_SPACES = np.ones(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of several texts, and the texts' offsets in them."""
    inside = _SPACES[data]
    begins = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[begins] = inside[begins]
    end[:-1] &= ~inside[1:]
    end[begins[1:] - 1] = inside[begins[1:] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets - offsets[0])


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all words of the texts, and the texts' offsets in them."""
    hashes, counts, at = [np.zeros(0, _U64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) <= CHUNK_BYTES:
            size, end = size + len(texts[end]), end + 1
        lengths = np.fromiter(map(len, texts[at:end]), dtype=np.int64, count=end - at)
        data = np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8)
        starts, ends, offsets = word_spans(data, np.concatenate(([0], np.cumsum(lengths))))
        hashes.append(span_hashes(data, starts, ends) >> _U64(8 * (8 - WORD_BYTES)))
        counts.append(np.diff(offsets))
        at = end
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return mix(np.arange(1, ANCHOR_WORDS + 1, dtype=_U64)) | _U64(1)


def anchors(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window its first word's place, its text's number and its anchor."""
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(first):
        return first, text, np.zeros(0, _U64)
    span = min(ANCHOR_WORDS, window)
    sums = np.zeros(len(words) - span + 1, dtype=_U64)
    with np.errstate(over="ignore"):
        for k in range(span):
            sums += words[k : k + len(sums)] * _factors()[k]
    least = mix(sums)
    # The minimum over ``reach`` neighbours from minima over powers of two.
    reach, have = window - span + 1, 1
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return first, text, least[first]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where each different key begins in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate(([len(keys) > 0], ordered[1:] != ordered[:-1])))
    return order, begins


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Automaton:
    """The suffix automaton of several word sequences; states know the smallest document of their words."""

    def __init__(self, sequences: Sequence[list], documents: Sequence[int], window: int) -> None:
        moves: list[dict] = [{}]
        link, length, least = [-1], [0], [LAST]
        for words, document in zip(sequences, documents, strict=True):
            last = 0
            for word in words:
                new = moves[last].get(word)
                if new is None or length[new] != length[last] + 1:
                    at, grown = last, length[last] + 1
                    if new is None:
                        new = len(moves)
                        moves.append({})
                        link.append(0)
                        length.append(grown)
                        least.append(LAST)
                        while at >= 0 and word not in moves[at]:
                            moves[at][word] = new
                            at = link[at]
                        target = moves[at][word] if at >= 0 else 0
                        split = at >= 0 and length[at] + 1 != length[target]
                        if not split:
                            link[new] = target
                    else:
                        target, split = new, True
                    if split:
                        clone = len(moves)
                        moves.append(dict(moves[target]))
                        link.append(link[target])
                        length.append(length[at] + 1)
                        least.append(LAST)
                        while at >= 0 and moves[at].get(word) == target:
                            moves[at][word] = clone
                            at = link[at]
                        link[target] = clone
                        if new == target:
                            new = clone
                        else:
                            link[new] = clone
                last = new
                if document < least[last]:
                    least[last] = document
        for state in sorted(range(1, len(moves)), key=length.__getitem__, reverse=True):
            above = link[state]
            if length[above] >= window and least[state] < least[above]:
                least[above] = least[state]
        self.moves, self.link, self.length, self.least, self.window = moves, link, length, least, window

    def first_documents(self, words: list) -> list[int]:
        """For each window of ``words`` the smallest document that holds it, or ``LAST``.

        One pass keeps the longest match that ends at each word; where it reaches a whole window,
        the shortest state that still spans one answers.
        """
        moves, link, length, window = self.moves, self.link, self.length, self.window
        out, state, matched = [], 0, 0
        for place, word in enumerate(words, 1):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            if place >= window:
                if matched < window:
                    out.append(LAST)
                    continue
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                out.append(self.least[at])
        return out


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _packed_words(words: np.ndarray) -> bytes:
    return _bytes(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])


def _unpacked_words(parts: Sequence[bytes]) -> np.ndarray:
    out = np.zeros((sum(map(len, parts)) // WORD_BYTES, 8), dtype=np.uint8)
    out[:, :WORD_BYTES] = _joined(parts, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8")[:, 0]


def _joined(parts: Sequence[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows of one value of the first column, without that column."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > 4 << 20 or len(held) == 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _map(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> DataFrame:
    schema = _schema(ddl)
    return rows.mapInArrow(lambda batches: _batches(function(batches), schema), ddl)


def _texts(rows: list[tuple]) -> tuple[np.ndarray, list[bytes]]:
    """Document numbers and texts of rows (doc_id, text)."""
    ids = np.fromiter((LAST if d is None else d for d, _ in rows), dtype=np.int64, count=len(rows))
    return ids, [(t or "").encode() for _, t in rows]


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text, size): the documents dealt to blocks as they are read, stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            blocks = np.empty(batch.num_rows, dtype=np.int64)
            sizes = batch.column(2).to_numpy()
            for i, size in enumerate(sizes.tolist()):
                if held and held + size > BLOCK_BYTES:
                    block, held = block + 1, 0
                blocks[i] = block
                held += size
            yield pa.record_batch([pa.array(blocks), *batch.columns], names=["block", "doc_id", "text", "size"])

    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    )
    return staged(chosen.mapInArrow(run, "block long, doc_id long, text string, size long"))


def _repeated_anchors(texts: DataFrame, buckets: int, window: int, hot: int) -> DataFrame:
    """(block, cold, hot): the anchors of each block that two documents hold, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, rows in _by_key(batches):
            ids, own = _texts(rows)
            _, text, anchor = anchors(*word_hashes(own), window)
            fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))[: len(anchor)])
            anchor, document = anchor[fresh], ids[text[fresh]]
            order, begins = _grouped(anchor)
            if not len(begins):
                continue
            anchor, document = anchor[order][begins], document[order]
            low, high = np.minimum.reduceat(document, begins), np.maximum.reduceat(document, begins)
            count = np.diff(np.append(begins, len(document))).astype(np.uint32)
            bucket = (anchor % _U64(buckets)).astype(np.int64)
            order, begins = _grouped(bucket)
            for a, b in zip(begins, np.append(begins[1:], len(order)), strict=True):
                some = order[a:b]
                packed = (anchor[some], low[some], high[some] - low[some], count[some])
                yield int(bucket[some[0]]), block, *map(_bytes, packed)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in _by_key(batches):
            anchor, low, span, count = (
                _joined([r[k] for r in rows], kind) for k, kind in ((1, _U64), (2, np.int64), (3, np.int64), (4, np.uint32))
            )
            order, begins = _grouped(anchor)
            least = np.minimum.reduceat(low[order], begins)
            most = np.maximum.reduceat((low + span)[order], begins)
            often = np.add.reduceat(count[order].astype(np.int64), begins) > hot
            names, repeated = anchor[order][begins], least < most
            cold, crowded = names[repeated & ~often], names[repeated & often]
            for block, packed, *_ in rows:
                asked = np.frombuffer(packed, _U64)
                answers = asked[_member(asked, cold)], asked[_member(asked, crowded)]
                if len(answers[0]) or len(answers[1]):
                    yield block, *map(_bytes, answers)

    sent = _map(
        texts.select("block", "doc_id", "text"),
        send,
        "bucket long, block long, anchors binary, lows binary, spans binary, counts binary",
    )
    met = sent.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return _map(met, answer, "block long, cold binary, hot binary")


def _tasks(frame: DataFrame, least: int) -> int:
    return max(least, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _beside(texts: DataFrame, answers: DataFrame, names: list[str], tasks: int) -> DataFrame:
    """Texts of a block and the answers to it in one task, the answers first."""
    none = [F.lit(None).cast("binary").alias(n) for n in names]
    own = texts.select("block", F.lit(1).alias("kind"), "doc_id", "text", *none)
    other = answers.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *names)
    both = own.unionByName(other).repartition(_tasks(texts, tasks), "block")
    return both.sortWithinPartitions("block", "kind").select("block", "kind", "doc_id", "text", *names)


def _runs(texts: DataFrame, answers: DataFrame, shards: int, tasks: int, window: int) -> DataFrame:
    """(shard, block, keys, sizes, words, lows, spans): runs of windows with repeated anchors, packed.

    Each different run of a block is sent once, with the smallest document that holds it and the
    distance to the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, rows in _by_key(batches):
            cold, hot = (np.sort(_joined([r[k] for r in rows if not r[0]], _U64)) for k in (3, 4))
            ids, own = _texts([r[1:3] for r in rows if r[0]])
            if not len(cold) and not len(hot):
                continue
            words, offsets = word_hashes(own)
            first, text, anchor = anchors(words, offsets, window)
            joined, single = _member(anchor, cold), _member(anchor, hot)
            # Runs of neighbouring windows of one anchor; windows of crowded anchors stand alone.
            border = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))[: len(anchor)]
            begin = np.maximum.accumulate(np.where(border, np.arange(len(anchor)), 0))
            border |= (np.arange(len(anchor)) - begin) % MAX_RUN == 0
            starts = np.flatnonzero((border & joined) | single)
            every = np.flatnonzero(border | single)
            ends = np.append(every, len(anchor))[np.searchsorted(every, starts, side="right")]
            size = np.where(single[starts], 1, ends - starts)
            if not len(starts):
                continue
            at = first[starts]
            digest = span_hashes(words, at, at + size + window - 1)
            order, begins = _grouped(digest)
            document = ids[text[starts]][order]
            low, high = np.minimum.reduceat(document, begins), np.maximum.reduceat(document, begins)
            chosen = order[begins]
            at, size, starts = at[chosen], size[chosen], starts[chosen]
            key = np.where(single[starts], digest[chosen], anchor[starts])
            shard = (mix(key) % _U64(shards)).astype(np.int64)
            order, begins = _grouped(shard)
            for a, b in zip(begins, np.append(begins[1:], len(order)), strict=True):
                some = order[a:b]
                sent = _packed_words(words[_ranges(at[some], size[some] + window - 1)])
                ends_of = map(_bytes, (low[some], high[some] - low[some]))
                yield int(shard[some[0]]), block, _bytes(key[some]), _bytes(size[some].astype(np.uint8)), sent, *ends_of

    rows = _beside(texts, answers, ["cold", "hot"], tasks)
    return _map(rows, run, "shard long, block long, keys binary, sizes binary, words binary, lows binary, spans binary")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _first_documents(words: np.ndarray, offsets: np.ndarray, keys: np.ndarray, documents: np.ndarray, window: int) -> np.ndarray:
    """For all windows of different runs, in order, the smallest document that holds them.

    Runs are taken by key, with as many keys to an automaton as its bound allows.
    """
    out = np.empty(len(words) - (window - 1) * len(keys), dtype=np.int64)
    _, numbers = np.unique(words, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    sizes, place = np.diff(offsets), offsets[:-1] - (window - 1) * np.arange(len(keys))
    begins = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    filled = np.add.reduceat(sizes[order], begins)
    at = 0
    while at < len(begins):
        end = at + max(1, int(np.searchsorted(np.cumsum(filled[at:]), AUTOMATON_WORDS, side="right")))
        some = order[begins[at] : begins[end] if end < len(begins) else len(order)]
        sequences = [numbers[offsets[i] : offsets[i + 1]].tolist() for i in some]
        automaton = Automaton(sequences, documents[some].tolist(), window)
        for i, sequence in zip(some, sequences, strict=True):
            found = automaton.first_documents(sequence)
            out[place[i] : place[i] + len(found)] = found
        at = end
    return out


def _covered_windows(runs: DataFrame, shards: int, window: int) -> DataFrame:
    """(block, gone, split, firsts): hashes of windows of a block that an earlier document holds.

    All documents of the block lose those of ``gone``. Those of ``split`` stand first in a document
    of the block itself, given in ``firsts``, and later ones lose them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in _by_key(batches):
            key, size, low, span = (
                _joined([r[k] for r in rows], kind) for k, kind in ((1, _U64), (2, np.uint8), (4, np.int64), (5, np.int64))
            )
            words = _unpacked_words([r[3] for r in rows])
            entries = np.fromiter((len(r[2]) for r in rows), dtype=np.int64, count=len(rows))
            length = size.astype(np.int64) + window - 1
            ends = np.cumsum(length)
            digest = span_hashes(words, ends - length, ends)
            order, begins = _grouped(digest)
            chosen, which = order[begins], np.empty(len(digest), dtype=np.int64)
            which[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
            least = np.minimum.reduceat(low[order], begins)
            own = words[_ranges((ends - length)[chosen], length[chosen])]
            offsets = np.concatenate(([0], np.cumsum(length[chosen])))
            first = _first_documents(own, offsets, key[chosen], least, window)
            places = _ranges(offsets[:-1], length[chosen] - window + 1)
            hashes = span_hashes(own, places, places + window)
            # Every window of every entry of every block.
            n = size.astype(np.int64)
            begin = (offsets[:-1] - (window - 1) * np.arange(len(chosen)))[which]
            window_of = _ranges(begin, n)
            block = np.repeat(np.repeat(np.arange(len(rows)), entries), n)
            lows, highs = np.repeat(low, n), np.repeat(low + span, n)
            with np.errstate(over="ignore"):
                order, begins = _grouped(mix(hashes[window_of] + block.astype(_U64) * _U64(0x9E3779B97F4A7C15)))
            one = order[begins]
            lows, highs = np.minimum.reduceat(lows[order], begins), np.maximum.reduceat(highs[order], begins)
            found, name, block = first[window_of[one]], hashes[window_of[one]], block[one]
            gone, split = found < lows, (found == lows) & (lows < highs)
            order, begins = _grouped(block)
            for a, b in zip(begins, np.append(begins[1:], len(order)), strict=True):
                some = order[a:b]
                whole, part = some[gone[some]], some[split[some]]
                if len(whole) or len(part):
                    yield rows[block[some[0]]][0], _bytes(name[whole]), _bytes(name[part]), _bytes(found[part])

    met = runs.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return _map(met, run, "block long, gone binary, split binary, firsts binary")


def covered_spans(gone: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words the windows that begin at the places ``gone`` cover, and the spans of those words."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + window, -1)
    covered = np.cumsum(change)[:n_words] > 0
    return covered, np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row of ``RESULT`` for each row of ``docs`` (doc_id, text).

    Words are runs of bytes other than spaces, tabs, line and page breaks. Removed are all words
    under a window of ``window`` words that also stands, in the input, in a document with a smaller
    doc_id. ``spans`` are the removed ranges of words, end exclusive, and ``kept`` the other words
    joined by one space. NULL and empty texts have no words; a text shorter than a window stays; rows
    of one doc_id do not remove each other's words; a NULL doc_id is later than any other, and not
    earlier than another NULL. Other columns are ignored; no rows give no rows.
    """
    if window < ANCHOR_WORDS:
        raise ValueError(f"a window has at least {ANCHOR_WORDS} words")
    spark = docs.sparkSession
    texts = _blocks(docs)
    total = texts.agg(F.sum("size")).first()[0] or 0
    # A bucket and a shard is a task.
    buckets, shards = (_tasks(texts, -(-total // size)) for size in (BUCKET_BYTES, SHARD_BYTES))
    with shuffle_files_removed(spark):
        answers = staged(_repeated_anchors(texts, buckets, window, hot))
        found = staged(_covered_windows(_runs(texts, answers, shards, shards, window), shards, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            gone, split, firsts = (_joined([r[k] for r in rows if not r[0]], kind) for k, kind in ((3, _U64), (4, _U64), (5, np.int64)))
            order = np.argsort(split)
            gone, split, firsts = np.sort(gone), split[order], firsts[order]
            named = [r[1:3] for r in rows if r[0]]
            ids, own = _texts(named)
            # Word hashes are needed only where the block holds something that goes.
            hashed = word_hashes(own) if len(gone) or len(split) else None
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, text in enumerate(own):
                words, spans = text.split(), np.zeros((0, 2), dtype=np.int64)
                if hashed and len(words) >= window:
                    mine = hashed[0][hashed[1][i] : hashed[1][i + 1]]
                    at = np.arange(len(mine) - window + 1)
                    names = span_hashes(mine, at, at + window)
                    lost = _member(names, gone)
                    if len(split):
                        place = np.minimum(np.searchsorted(split, names), len(split) - 1)
                        lost |= (split[place] == names) & (firsts[place] < ids[i])
                    covered, spans = covered_spans(np.flatnonzero(lost), len(mine), window)
                kept = b" ".join(compress(words, (~covered).tolist()) if len(spans) else words)
                row = named[i][0], len(words), int((spans[:, 1] - spans[:, 0]).sum()), spans, kept
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                size += len(kept)
                if size > 4 << 20:
                    yield _results(out)
                    out, size = [[], [], [], [], []], 0
            if out[0]:
                yield _results(out)

    return _beside(texts, found, ["gone", "split", "firsts"], shards).mapInArrow(run, RESULT)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _results(columns: list[list]) -> pa.RecordBatch:
    ids, words, removed, spans, kept = columns
    flat = np.concatenate([np.zeros((0, 2), dtype=np.int64), *spans])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], fields=list(_SPAN))
    arrays = [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
    arrays += [pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array([k.decode() for k in kept], pa.string())]
    return pa.record_batch(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept"])
