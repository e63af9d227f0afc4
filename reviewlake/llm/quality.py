"""Quality scores: random-indexing word vectors, pooled per document, and a small network.

Every word has a sparse random index vector. A word's vector is the sum of the index
vectors of the words around it, over all documents, so it needs one pass and no
training. Words are hashed to ``ROWS`` rows: the table has a fixed size whatever the
vocabulary. A document is the mean and the spread of its words' vectors. A two-layer
network in numpy learns from a bounded sample of labelled documents, and a temperature
fitted on a part it has not seen calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.text_arrays import code_points, groups, mix, span_hashes
from reviewlake.session import broadcast_if_bounded, persist_reliably

ROWS_BITS = 15
ROWS = 1 << ROWS_BITS
DIMENSIONS = 64
#: Entries of an index vector that are not zero.
NONZERO = 4
#: Words to each side that a word's vector takes up.
CONTEXT = 2
#: So many contexts can be added in a 16-bit lane.
LANE_RUN = 65_535 // (4 * CONTEXT)
#: The table of vectors travels in this many parts.
PARTS = 64
#: Bound of the sample that the network learns from.
SAMPLE_DOCS = 20_000
HIDDEN = 32
EPOCHS = 40
BATCH = 256
RATE = 0.01
DECAY = 1e-4
SEED = 7


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for white space and NUL, 1 for letters and digits, 2 for all other signs."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for point in range(1, 0x110000):
        sign = chr(point)
        out[point] = 1 if sign.isalnum() else 0 if sign.isspace() else 2
    return out


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """The random index vector of every row: ``NONZERO`` entries of +1 or -1.

    One more row of zeros stands for the places between texts.
    """
    out = np.zeros((ROWS + 1, DIMENSIONS), dtype=np.int8)
    draws = mix(np.arange(1, ROWS * NONZERO + 1, dtype=np.uint64)).reshape(ROWS, NONZERO)
    place = (draws % np.uint64(DIMENSIONS)).astype(np.int64)
    sign = np.where(draws >> np.uint64(63), 1, -1).astype(np.int8)
    for k in range(NONZERO):
        out[np.arange(ROWS), place[:, k]] = sign[:, k]
    return out


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table row of every word of the texts, and each text's offset in them.

    Words are runs of letters and digits, as they are written, or runs of other signs.
    """
    points, text_starts = code_points(texts, "\0")
    kinds = _kinds()[points]
    edges = np.flatnonzero(np.diff(kinds, prepend=0))
    ends = np.append(edges[1:], len(kinds))
    words = kinds[edges] > 0
    starts, ends = edges[words], ends[words]
    rows = (span_hashes(points, starts, ends) >> np.uint64(64 - ROWS_BITS)).astype(np.int64)
    return rows, np.searchsorted(starts, text_starts)


def add_contexts(table: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words around it in its text."""
    if not len(rows):
        return
    texts = len(offsets) - 1
    place = np.arange(len(rows)) + CONTEXT * (1 + np.repeat(np.arange(texts), np.diff(offsets)))
    spaced = np.full(len(rows) + CONTEXT * (texts + 1), ROWS)
    spaced[place] = rows
    vectors = index_vectors()[spaced]
    context = np.zeros((len(spaced) - 2 * CONTEXT, DIMENSIONS), dtype=np.int8)
    for k in range(1, CONTEXT + 1):
        context += vectors[CONTEXT - k : len(spaced) - CONTEXT - k]
        context += vectors[CONTEXT + k : len(spaced) - CONTEXT + k]
    # Rows in order; their contexts, made positive, are added in 16-bit lanes, four to a word,
    # over runs short enough for a lane.
    order = np.argsort(rows.astype(np.uint16) if ROWS_BITS <= 16 else rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    sizes = np.diff(np.append(first, len(rows)))
    runs = -(-sizes // LANE_RUN)
    starts = np.repeat(first - LANE_RUN * (np.cumsum(runs) - runs), runs) + LANE_RUN * np.arange(runs.sum())
    positive = (context[place[order] - CONTEXT] + np.int8(2 * CONTEXT)).astype(np.uint16)
    sums = np.add.reduceat(positive.view(np.uint64), starts).view(np.uint16).astype(np.int64)
    sums -= 2 * CONTEXT * np.diff(np.append(starts, len(rows)))[:, None]
    if len(starts) == len(first):
        table[ordered[first]] += sums
    else:  # a word with several runs
        np.add.at(table, ordered[starts], sums)


def fit_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit word vectors over all texts of ``docs``.

    A task adds up its documents and sends the table in ``PARTS`` parts; parts are added as
    streams. The result has ``ROWS`` times ``DIMENSIONS`` numbers whatever the input.
    """
    size = ROWS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros((ROWS, DIMENSIONS), dtype=np.int64), False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in groups(texts):
                add_contexts(table, *word_rows(texts[lo:hi]))
                seen = True
        if seen:
            parts = [table[k * size : (k + 1) * size].astype("<i4" if np.abs(table).max() < 2**31 else "<i8") for k in range(PARTS)]
            columns = [pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.record_batch(columns, names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, "<i4" if len(data) == 4 * size * DIMENSIONS else "<i8")
                sums[part] = sums.get(part, 0) + values.astype(np.int64)
        columns = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.record_batch(columns, names=["part", "sums"])

    kind = "part int, sums binary"
    parts = docs.select("text").filter("text IS NOT NULL").mapInArrow(count, kind)
    table = np.zeros((PARTS, size * DIMENSIONS), dtype=np.float64)
    for row in parts.repartition(PARTS, "part").mapInArrow(add, kind).collect():
        table[row["part"]] = np.frombuffer(row["sums"], "<i8")
    table = table.reshape(ROWS, DIMENSIONS)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of their number."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), dtype=np.float32)
    for lo, hi in groups(texts):
        rows, offsets = word_rows(texts[lo:hi])
        counts = np.diff(offsets)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        found = vectors[rows]
        for text in full.tolist():
            own = found[offsets[text] : offsets[text + 1]]
            mean = own.mean(axis=0, dtype=np.float64)
            square = np.einsum("ij,ij->j", own, own, dtype=np.float64) / len(own)
            out[lo + text, :DIMENSIONS] = mean
            out[lo + text, DIMENSIONS:-1] = np.sqrt(np.maximum(square - mean**2, 0))
            out[lo + text, -1] = np.log1p(len(own))
    return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of the output."""

    center: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((features - self.center) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return _sigmoid(self.logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(features: np.ndarray, labels: np.ndarray) -> Network:
    """Fit the network on four fifths of the rows and its temperature on the others.

    With no rows, or one kind of label only, it scores the share of label 1 (a half without
    rows) for every text.
    """
    width = features.shape[1]
    rng = np.random.default_rng(SEED)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    center = features.mean(axis=0) if len(labels) else np.zeros(width)
    spread = features.std(axis=0) if len(labels) else np.ones(width)
    net = Network(
        center,
        np.where(spread > 1e-6, spread, 1.0),
        rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)),
        np.zeros(HIDDEN),
        np.zeros(HIDDEN),
        float(np.log(share / (1 - share))),
    )
    if len(np.unique(labels)) < 2:
        return net
    order = rng.permutation(len(labels))
    kept = order[: max(1, len(order) // 5)]
    learnt = order[len(kept) :] if len(order) >= 50 else order
    inputs = (features - net.center) / net.scale
    weights = [net.first, net.first_bias, net.second, np.array(net.second_bias)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(learnt)
        for at in range(0, len(learnt), BATCH):
            rows = learnt[at : at + BATCH]
            x, y = inputs[rows], labels[rows]
            hidden = np.tanh(x @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - y) / len(rows)
            back = (error[:, None] * weights[2]) * (1 - hidden**2)
            slopes = [x.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                m, v = moments[k]
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                moments[k] = (m, v)
                weights[k] = weights[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = *weights[:3], float(weights[3])
    logits, truth = net.logits(features[kept]), labels[kept]
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)) for t in tried]
    net.temperature = float(tried[int(np.argmin(loss))])
    return net


def fit_network(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_docs: int = SAMPLE_DOCS) -> Network:
    """Learn from the documents that ``labels`` (doc_id, label 0 or 1) names.

    Rows with a NULL id or another label are left out, and a document labelled both ways
    counts as 0. Of more than ``sample_docs`` labelled documents those of smallest id hash
    are taken.
    """
    one = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = persist_reliably(one.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_docs))
    texts = docs.select("doc_id", "text").join(broadcast_if_bounded(chosen, sample_docs), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = pooled([t or "" for t in batch.column(2).to_pylist()], vectors)
            rows = pa.array([row.tobytes() for row in features], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), rows], names=["doc_id", "label", "features"])

    wide = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    found = wide.mapInArrow(run, "doc_id long, label int, features binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    features = np.array([np.frombuffer(r["features"], np.float32) for r in found], dtype=np.float64)
    return train(features.reshape(-1, 2 * DIMENSIONS + 1), np.array([r["label"] for r in found], dtype=np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of each row's whole text; NULL texts count as empty.

    Repeated rows give a row each, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = network.scores(pooled(batch.column(1).to_pylist(), vectors))
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")
