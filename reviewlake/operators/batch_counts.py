"""Counts of terms and letter trigrams in Arrow batches.

Spark cuts texts into tokens and adds the counts up; a task counts the rows of a batch together
in numpy, where a lambda over each row's array would be interpreted for every token. Rows are taken
in slices of a bounded size, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reviewlake.session import ship_package

#: Tokens, and bytes of text, that are counted at a time; texts stay in the processor's cache.
SLICE = 1 << 20
SLICE_BYTES = 1 << 18
#: Up to so many possible values are numbered by a table, more by sorting.
MAX_CELLS = 1 << 22
_CODE_POINTS = 0x110000


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` items, one row at least."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


def numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below ``bound``, ascending, and the place of each value among them."""
    if bound > MAX_CELLS:
        return np.unique(values, return_inverse=True)
    present = np.zeros(bound, dtype=bool)
    present[values] = True
    distinct = np.flatnonzero(present)
    place = np.empty(bound, dtype=np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[values]


# --- tokens -----------------------------------------------------------------


def coded(tokens: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of lists: the first row, each token's row in the slice and number, the distinct tokens."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    for lo, hi in slices(sizes, SLICE):
        encoded = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
        rows = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        yield lo, rows, encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def neighbours(rows: np.ndarray, codes: np.ndarray, words: pa.Array, kept: np.ndarray | None = None):
    """The pairs of neighbouring tokens of a row as (rows, numbers, distinct pairs); of ``kept`` words only."""
    inside = rows[:-1] == rows[1:]
    if kept is not None:
        inside &= kept[codes[:-1]] & kept[codes[1:]]
    n = max(len(words), 1)
    pairs, numbers = numbered(codes[:-1][inside] * n + codes[1:][inside], n * n)
    joined = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " ")
    return rows[:-1][inside], numbers, joined


def row_counts(rows: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, count) of the distinct numbers of each row."""
    n = max(n, 1)
    bound = (int(rows.max()) + 1) * n if len(rows) else 0
    if bound <= MAX_CELLS:
        every = np.bincount(rows * n + numbers, minlength=bound)
        found = np.flatnonzero(every)
        counts = every[found]
    else:
        found, counts = np.unique(rows * n + numbers, return_counts=True)
    return found // n, found % n, counts


def term_stats(valid: DataFrame, pairs: bool = False, among: list[str] | None = None) -> DataFrame:
    """(term, total, df): all tokens of the column ``tokens``, or all pairs of neighbours, ``among`` words only."""
    ship_package(valid.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if among is None else pa.array(among, pa.string())
        for batch in batches:
            for _, rows, codes, terms in coded(batch.column(0)):
                if pairs:
                    kept = None if listed is None else pc.is_in(terms, listed.cast(terms.type)).to_numpy(zero_copy_only=False)
                    rows, codes, terms = neighbours(rows, codes, terms, kept)
                _, of, counts = row_counts(rows, codes, len(terms))
                total = np.bincount(codes, minlength=len(terms)).astype(np.int64)
                documents = np.bincount(of, minlength=len(terms)).astype(np.int64)
                columns = [terms.cast(pa.string()), pa.array(total), pa.array(documents)]
                yield pa.record_batch(columns, names=["term", "total", "df"])

    parts = valid.select("tokens").mapInArrow(count, "term string, total long, df long")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def row_terms(valid: DataFrame, key: str, listed: list[str] | None = None) -> DataFrame:
    """(key, term, tf): the distinct tokens and pairs of neighbours of each row, ``listed`` ones only."""
    ship_package(valid.sparkSession)
    schema = StructType([valid.schema[key], StructField("term", StringType()), StructField("tf", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if listed is None else pa.array(listed, pa.string())
        halves = None if listed is None else pa.array(sorted({w for t in listed if " " in t for w in t.split(" ")}), pa.string())
        for batch in batches:
            keys = batch.column(0)
            for lo, rows, codes, words in coded(batch.column(1)):
                kept = None if halves is None else pc.is_in(words, halves.cast(words.type)).to_numpy(zero_copy_only=False)
                for of, numbers, terms in ((rows, codes, words), neighbours(rows, codes, words, kept)):
                    if wanted is not None:
                        known = pc.is_in(terms, wanted.cast(terms.type)).to_numpy(zero_copy_only=False)[numbers]
                        of, numbers = of[known], numbers[known]
                    row, number, counts = row_counts(of, numbers, len(terms))
                    columns = [keys.take(pa.array(row + lo)), terms.take(pa.array(number)).cast(pa.string()), pa.array(counts.astype(np.int64))]
                    yield pa.record_batch(columns, names=[key, "term", "tf"])

    return valid.select(key, "tokens").mapInArrow(count, schema)


def near_pairs(tokens: DataFrame, words: list[str], window: int) -> DataFrame:
    """(a, b, n): how often two of the ``words`` stand at most ``window`` places apart, ``a <= b``."""
    ship_package(tokens.sparkSession)
    words = sorted(set(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, size = pa.array(words, pa.string()), len(words)
        for batch in batches:
            for _, rows, codes, terms in coded(batch.column(0)):
                places = pc.fill_null(pc.index_in(terms, listed.cast(terms.type)), -1).to_numpy().astype(np.int64)
                own = places[codes] if len(places) else codes
                found = []
                for apart in range(1, window + 1):
                    x, y = own[:-apart], own[apart:]
                    both = (rows[:-apart] == rows[apart:]) & (x >= 0) & (y >= 0)
                    x, y = x[both], y[both]
                    found.append(np.minimum(x, y) * size + np.maximum(x, y))
                pairs, counts = np.unique(np.concatenate(found), return_counts=True)
                columns = [listed.take(pa.array(pairs // size)), listed.take(pa.array(pairs % size)), pa.array(counts.astype(np.int64))]
                yield pa.record_batch(columns, names=["a", "b", "n"])

    parts = tokens.select("tokens").mapInArrow(count, "a string, b string, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


# --- letter trigrams --------------------------------------------------------


def padded_letters(c: Column) -> Column:
    """The lower-cased text with one blank for all that is no letter between letters, and blanks around it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), F.lit(" "))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each trigram's letter, the number of the trigram, the (n, 3) code points of the distinct ones."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    letters = points[1:-1] != 0x20
    if not letters.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    alphabet, signs = numbered(points, _CODE_POINTS)
    size = len(alphabet)
    if size**3 > MAX_CELLS:
        signs = signs.astype(np.int64)
    cells, numbers = numbered(((signs[:-2] * size + signs[1:-1]) * size + signs[2:])[letters], size**3)
    distinct = np.stack([alphabet[cells // size**2], alphabet[cells // size % size], alphabet[cells % size]], axis=1)
    # The first and the last sign are blanks, so each letter has its neighbours.
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[1:-1][letters]
    return owner, numbers, distinct


def _text_slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    for lo, hi in slices(sizes, SLICE_BYTES):
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def language_trigrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, trigram, n) over all texts, one trigram per letter."""
    ship_package(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            codes, langs = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
            for lo, texts in _text_slices(batch.column(1)):
                owner, numbers, distinct = _trigrams(texts)
                row, number, counts = row_counts(codes[lo + owner], numbers, len(distinct))
                spelled = np.ascontiguousarray(distinct[number].astype("<u4")).view("<U3").ravel().tolist() if len(number) else []
                columns = [langs.take(pa.array(row)).cast(pa.string()), pa.array(spelled, pa.string()), pa.array(counts.astype(np.int64))]
                yield pa.record_batch(columns, names=["lang", "trigram", "n"])

    rows = df.select(F.col(lang).cast("string").alias("lang"), padded_letters(F.col(text)).alias("text"))
    parts = rows.where(F.col("lang").isNotNull()).mapInArrow(count, "lang string, trigram string, n long")
    return parts.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def _packed(points: np.ndarray) -> np.ndarray:
    """Three code points as one number."""
    return (points[:, 0] << 42) | (points[:, 1] << 21) | points[:, 2]


def trigram_sums(df: DataFrame, key: str, text: str, profile: pa.Table, languages: int) -> DataFrame:
    """(key, _n, _g0, ...): the trigrams of each text that has any, and the sums of their gains.

    ``profile`` holds (trigram, _g0, ...), one row per trigram, and is broadcast.
    """
    ship_package(df.sparkSession)
    spelled = profile["trigram"].to_pylist()
    whole = np.array([k for k, t in enumerate(spelled) if t is not None and len(t) == 3], dtype=np.int64)
    points = np.frombuffer("".join(spelled[k] for k in whole).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64).reshape(-1, 3)
    order = np.argsort(_packed(points))
    # One more row without gains stands for trigrams of no profile.
    gains = [np.append(profile[f"_g{i}"].to_numpy()[whole][order], 0).astype(np.int64) for i in range(languages)]
    shared = df.sparkSession.sparkContext.broadcast((_packed(points)[order], gains))
    names = ["_n", *(f"_g{i}" for i in range(languages))]
    schema = StructType([df.schema[key], *(StructField(c, LongType()) for c in names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains = shared.value
        for batch in batches:
            for lo, texts in _text_slices(batch.column(1)):
                owner, numbers, distinct = _trigrams(texts)
                if not len(owner):
                    continue
                wanted = _packed(distinct)
                place = np.searchsorted(known, wanted)
                if len(known):
                    place[known[np.minimum(place, len(known) - 1)] != wanted] = len(known)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                sums = [np.diff(np.append(starts, len(owner)))]
                sums += [np.add.reduceat(gain[place][numbers], starts) for gain in gains]
                columns = [batch.column(0).take(pa.array(lo + owner[starts])), *(pa.array(s.astype(np.int64)) for s in sums)]
                yield pa.record_batch(columns, names=[key, *names])

    return df.select(key, padded_letters(F.col(text)).alias("text")).mapInArrow(score, schema)
