"""word vectors learnt from the texts themselves, as an encoder for key phrases.

Words that occur near each other are counted in Spark. Their positive pointwise mutual
information is a sparse symmetric table, whose leading eigenvectors are found by a randomised
range finder: tasks multiply their part of the table with a thin matrix, Spark adds the parts,
and the driver makes the sum orthonormal. Table and matrix are whole numbers (fixed point), so
sums are exact and the vectors do not depend on how the rows are partitioned.

The vocabulary is bounded by ``MAX_WORDS``, so the thin matrix is too: at most
``MAX_WORDS * MAX_COLUMNS`` numbers are broadcast and collected in each step.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.functions.text import is_analysable, vectorizer_tokens
from reviewlake.lexicons import MAX_LITERAL_WORDS, STOPWORDS
from reviewlake.operators.batch_counts import near_pairs
from reviewlake.operators.phrases import top_terms
from reviewlake.session import persist_reliably, ship_package

MAX_WORDS = MAX_LITERAL_WORDS
MAX_COLUMNS = 160
WINDOW = 4
#: Defaults of a fit.
WORDS = 5_000
DIMENSIONS = 48
ITERATIONS = 3
#: Columns of the range finder beyond the dimensions.
OVERSAMPLING = 16
#: Fixed point of the table and of the orthonormal matrix. A sum is at most a row's length, 24 at
#: most an entry, so it needs 24 * sqrt(MAX_WORDS) * 2 ** 44 < 2 ** 63.
ENTRY_BITS = 16
MATRIX_BITS = 28
#: Words that are added up at a time.
CHUNK_WORDS = 1 << 16


def token_lists(df: DataFrame, text: str, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """``tokens`` of each analysable text, stored."""
    tokens = vectorizer_tokens(F.col(text), stopwords).alias("tokens")
    return persist_reliably(df.where(is_analysable(F.col(text))).select(tokens))


def frequent_words(tokens: DataFrame, k: int) -> list[str]:
    """The ``k`` most frequent words in their own order; ties by word."""
    if not 1 <= k <= MAX_WORDS:
        raise ValueError(f"a vocabulary has 1 to {MAX_WORDS} words")
    counts = tokens.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    return sorted(r["term"] for r in top_terms(persist_reliably(counts), k).select("term").collect())


def cooccurrences(tokens: DataFrame, words: list[str], window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two listed words stand at most ``window`` words apart, ``a <= b``.

    Words that are not listed keep their place but are left out inside the row. Counts are added
    up in each task before the shuffle.
    """
    if not words:
        return tokens.sparkSession.createDataFrame([], "a string, b string, n long")
    return near_pairs(tokens, words, int(window))


def positive_information(pairs: DataFrame) -> DataFrame:
    """(a, b, n, ppmi) of the pairs whose pointwise mutual information is positive.

    A pair counts once from each of its words, so a word beside itself counts twice.
    """
    sides = pairs.select(F.col("a").alias("term"), "n").unionAll(pairs.select(F.col("b").alias("term"), "n"))
    margins = persist_reliably(sides.groupBy("term").agg(F.sum("n").alias("margin")))
    whole = margins.agg(F.sum("margin").alias("whole"))
    both = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).cast("double")
    # At most MAX_WORDS margins.
    left = F.broadcast(margins.select(F.col("term").alias("a"), F.col("margin").cast("double").alias("of_a")))
    right = F.broadcast(margins.select(F.col("term").alias("b"), F.col("margin").cast("double").alias("of_b")))
    total = whole.scalar().cast("double")
    information = F.log(both * total / (F.col("of_a") * F.col("of_b")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", information.alias("ppmi")).where("ppmi > 0")


@dataclass(frozen=True)
class WordVectors:
    """An encoder: a text is the sum of its known words' vectors; without any it is zero."""

    words: tuple[str, ...]
    matrix: np.ndarray
    weights: np.ndarray

    def __call__(self, texts: list[str]) -> np.ndarray:
        place = self.__dict__.get("_place")
        if place is None:
            place = {w: i for i, w in enumerate(self.words)}
            object.__setattr__(self, "_place", place)
        ids: list[int] = []
        owners: list[int] = []
        out = np.zeros((len(texts), self.matrix.shape[1]))

        def flush() -> None:
            if ids:
                owner = np.array(owners)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[starts]] += np.add.reduceat(self.matrix[ids], starts, axis=0)
                ids.clear()
                owners.clear()

        for k, text in enumerate(texts):
            for word in re.finditer(r"\w\w+", text.lower()):
                at = place.get(word[0])
                if at is not None:
                    ids.append(at)
                    owners.append(k)
                    if len(ids) == CHUNK_WORDS:
                        flush()
        flush()
        return out


def _multiply(entries: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The table times a matrix of whole numbers, exactly.

    ``entries`` holds (i, j, value) once for each unordered pair. Each task adds its products up and
    sends the rows that it touched, one column of bytes each; their sums are added by row.
    """
    size, columns = matrix.shape
    shared = entries.sparkSession.sparkContext.broadcast(matrix)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((size, columns), dtype=np.int64)
        touched = np.zeros(size, dtype=bool)
        for batch in batches:
            i, j, value = (batch.column(k).to_numpy() for k in range(3))
            off = i != j
            rows, others = np.concatenate((i, j[off])), np.concatenate((j, i[off]))
            values = np.concatenate((value, value[off]))
            order = np.argsort(rows, kind="stable")
            rows, others, values = rows[order], others[order], values[order]
            for at in range(0, len(rows), CHUNK_WORDS):
                some = slice(at, at + CHUNK_WORDS)
                starts = np.flatnonzero(np.diff(rows[some], prepend=-1))
                total[rows[some][starts]] += np.add.reduceat(own[others[some]] * values[some, None], starts, axis=0)
                touched[rows[some][starts]] = True
        found = np.flatnonzero(touched)
        for at in range(0, len(found), 1024):
            some = found[at : at + 1024]
            sums = pa.array(list(total[some]), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(some.astype(np.int32)), sums], names=["i", "sums"])

    parts = entries.select("i", "j", "value").mapInArrow(products, "i int, sums array<long>")
    added = parts.groupBy("i").agg(*(F.sum(F.col("sums")[k]).alias(f"c{k}") for k in range(columns)))
    out = np.zeros((size, columns), dtype=np.int64)
    rows = added.toArrow()
    if rows.num_rows:
        out[rows["i"].to_numpy()] = np.stack([rows[f"c{k}"].to_numpy() for k in range(columns)], axis=1)
    shared.unpersist()
    return out


def leading_eigenvectors(
    entries: DataFrame, size: int, dimensions: int, iterations: int = ITERATIONS, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The ``dimensions`` eigenvalues of largest size of a symmetric table, and their vectors as columns.

    ``entries`` is a stored (i, j, value) with whole values of ``ENTRY_BITS`` binary places.
    """
    columns = min(size, dimensions + OVERSAMPLING)
    if columns > MAX_COLUMNS:
        raise ValueError(f"at most {MAX_COLUMNS - OVERSAMPLING} dimensions")
    start = np.random.default_rng(seed).choice(np.array([-1, 1]), (size, columns))
    basis = np.linalg.qr(start.astype(float))[0]

    def times(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fixed = np.rint(q * 2**MATRIX_BITS).astype(np.int64)
        return fixed / 2**MATRIX_BITS, _multiply(entries, fixed) / 2.0 ** (MATRIX_BITS + ENTRY_BITS)

    for _ in range(iterations):
        basis = np.linalg.qr(times(basis)[1])[0]
    basis, image = times(basis)
    small = basis.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    largest = np.argsort(-np.abs(values), kind="stable")[:dimensions]
    vectors = basis @ turns[:, largest]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(largest))])
    return values[largest], vectors * signs


def fit_word_vectors(
    df: DataFrame,
    text: str,
    stopwords: Iterable[str] = STOPWORDS,
    dimensions: int = DIMENSIONS,
    max_words: int = WORDS,
    window: int = WINDOW,
    iterations: int = ITERATIONS,
) -> WordVectors:
    """An encoder from all analysable texts; the ``max_words`` most frequent words have a vector.

    NULL and short texts teach nothing; without any positive association every vector is empty.
    """
    spark = df.sparkSession
    ship_package(spark)
    tokens = token_lists(df, text, stopwords)
    words = frequent_words(tokens, max_words)
    known = persist_reliably(positive_information(persist_reliably(cooccurrences(tokens, words, window))))
    places = F.broadcast(spark.createDataFrame(list(enumerate(words)), "place int, term string"))
    value = F.round(F.col("ppmi") * 2**ENTRY_BITS).cast("long").alias("value")
    entries = persist_reliably(
        known.join(places.withColumnsRenamed({"place": "i", "term": "a"}), "a")
        .join(places.withColumnsRenamed({"place": "j", "term": "b"}), "b")
        .select("i", "j", value)
    )
    if not words or entries.isEmpty():
        return WordVectors(tuple(words), np.zeros((len(words), 0)), np.zeros(0))
    values, vectors = leading_eigenvectors(entries, len(words), dimensions, iterations)
    return WordVectors(tuple(words), vectors * np.sqrt(np.abs(values)), values)
