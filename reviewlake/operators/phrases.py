"""Key phrases by TF-IDF (F14, A13, T2) and by embedding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reviewlake.functions.arrays import empty_strings
from reviewlake.functions.text import is_analysable, vectorizer_tokens
from reviewlake.lexicons import MAX_LITERAL_WORDS, STOPWORDS
from reviewlake.operators.batch_counts import row_terms, term_stats
from reviewlake.session import persist_reliably, ship_package

#: Up to so many features pass through the driver; a larger vocabulary stays a table.
MAX_COLLECTED_FEATURES = 20_000
#: Counting cells of one refinement, and ties that are few enough to be sorted at once.
CELLS = 1024
MAX_SORTED_TIES = 10_000

VOCABULARY_SCHEMA = "term string, total long, df long, idf double"


def _short_list(terms: DataFrame) -> list[str] | None:
    """The terms if they are few enough for a plan literal, else None."""
    rows = terms.limit(MAX_LITERAL_WORDS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= MAX_LITERAL_WORDS else None


def kth_largest(counts: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """The ``k``-th largest whole number of a column, and how many are larger; None if there are fewer.

    The range that must hold it is cut into ``CELLS`` cells, their rows are counted, and the cell
    in which the count from above reaches ``k`` is the next range: a few scans of one stored
    column, and ``CELLS`` rows for the driver, however many numbers there are.
    """
    ends = counts.agg(F.min(column), F.max(column), F.count(column)).first()
    if ends[2] < k:
        return None
    low, high, above = ends[0], ends[1], 0
    while low < high:
        width = -(-(high - low + 1) // CELLS)
        cell = F.expr(f"(`{column}` - {low}L) div {width}L")
        inside = counts.where(F.col(column).between(low, high))
        found = inside.groupBy(cell.alias("cell")).count().orderBy(F.desc("cell")).collect()
        for row in found:
            if above + row["count"] >= k:
                low, high = low + row["cell"] * width, min(high, low + (row["cell"] + 1) * width - 1)
                break
            above += row["count"]
    return low, above


def kth_smallest_text(texts: DataFrame, column: str, k: int) -> str:
    """The ``k``-th smallest of at least ``k`` different texts, in the order of code points.

    Texts are counted by their next sign after the prefix that is known so far, until few enough
    are left to be sorted.
    """
    prefix, left = "", texts.select(column)
    while True:
        few = left.limit(MAX_SORTED_TIES + 1).count()
        if few <= MAX_SORTED_TIES:
            return sorted(r[0] for r in left.collect())[k - 1]
        sign = F.substring(F.col(column), len(prefix) + 1, 1)
        for row in sorted(left.groupBy(sign.alias("sign")).count().collect()):
            if row["count"] >= k:
                break
            k -= row["count"]
        if not row["sign"]:
            return prefix
        prefix += row["sign"]
        left = left.where(F.startswith(F.col(column), F.lit(prefix)))


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of a stored table (term, total, ...) of largest total, ties by term ascending.

    Only the last total and the last term that stay are found; the rows are a filter of the table.
    """
    last = kth_largest(counts, "total", k)
    if last is None:
        return counts
    total, above = last
    term = kth_smallest_text(counts.where(F.col("total") == total), "term", k - above)
    return counts.where((F.col("total") > total) | ((F.col("total") == total) & (F.col("term") <= term)))


def fit_vocabulary(
    df: DataFrame,
    text: str,
    stopwords: Iterable[str] = STOPWORDS,
    max_features: int = 1000,
    max_df: float = 0.8,
    min_df: int = 1,
) -> DataFrame:
    """The ``max_features`` most frequent terms with their idf (spec 2.13, steps 1-5).

    Counting every bigram would shuffle about as much as the text itself, so it
    runs in two steps. Words are counted first; the last word that could still be
    a feature sets a threshold. A bigram is never more frequent than its rarer
    word, so only bigrams of two words at or above the threshold can be features,
    and the rest are dropped before the shuffle. The result is exact. Both steps read
    stored token lists, so texts are cut once.
    """
    tokens = vectorizer_tokens(F.col(text), stopwords).alias("tokens")
    valid = persist_reliably(df.where(is_analysable(F.col(text))).select(tokens))
    return _vocabulary_of(valid, max_features, max_df, min_df)


def _vocabulary_of(valid: DataFrame, max_features: int, max_df: float, min_df: int) -> DataFrame:
    """The vocabulary of a column ``tokens``, which is read twice."""
    if max_features < 1:
        raise ValueError("max_features must be positive")
    spark = valid.sparkSession
    documents = valid.count()
    words = persist_reliably(term_stats(valid))
    if documents <= 1:
        return spark.createDataFrame([], VOCABULARY_SCHEMA)

    allowed = (F.col("df") <= max_df * documents) & (F.col("df") >= min_df)
    by_frequency = [F.desc("total"), F.asc("term")]
    kept = words.where(allowed)
    if max_features > MAX_COLLECTED_FEATURES:
        return _large_vocabulary(valid, kept, allowed, documents, max_features)
    top_words = kept.orderBy(*by_frequency).limit(max_features).collect()
    threshold = top_words[-1]["total"] if len(top_words) == max_features else 1

    frequent = _short_list(words.where(F.col("total") >= threshold).select("term")) if threshold > 1 else None
    pair_stats = term_stats(valid, pairs=True, among=frequent).where(
        allowed & (F.col("total") >= threshold)
    )
    # At most max_features rows on each side from here on.
    words_again = spark.createDataFrame(
        [(r["term"], r["total"], r["df"]) for r in top_words], "term string, total long, df long"
    )
    best = (
        pair_stats.orderBy(*by_frequency)
        .limit(max_features)
        .unionByName(words_again)
        .orderBy(*by_frequency)
        .limit(max_features)
        .collect()
    )
    rows = [
        (r["term"], r["total"], r["df"], math.log((1 + documents) / (1 + r["df"])) + 1.0)
        for r in best
    ]
    return spark.createDataFrame(rows, VOCABULARY_SCHEMA)


def _large_vocabulary(valid: DataFrame, words: DataFrame, allowed: Column, documents: int, max_features: int) -> DataFrame:
    """The vocabulary as a stored table, without a list of terms on the driver.

    A pair of words can be a feature only if its total reaches that of the last word that could be
    one, so rarer pairs are left out when their counts are stored.
    """
    last = kth_largest(words, "total", max_features)
    pairs = term_stats(valid, pairs=True).where(allowed & (F.col("total") >= (last[0] if last else 1)))
    counted = persist_reliably(words.unionByName(pairs))
    idf = F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1.0
    return persist_reliably(top_terms(counted, max_features).select("term", "total", "df", idf.alias("idf")))


def term_scores(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, stopwords: Iterable[str] = STOPWORDS
) -> DataFrame:
    """(key, term, tf, score) of the vocabulary terms of each analysable text.

    Counts are made inside the row, and a vocabulary of up to ``MAX_LITERAL_WORDS``
    terms is broadcast, so this step does not shuffle.
    """
    tokens = vectorizer_tokens(F.col(text), stopwords).alias("tokens")
    return _scores_of(df.where(is_analysable(F.col(text))).select(key, tokens), key, vocabulary)


def _scores_of(valid: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    listed = _short_list(vocabulary.select("term"))
    counted = row_terms(valid, key, listed)
    weights = vocabulary.select("term", "idf")
    if listed is not None:  # a longer vocabulary is left to the optimiser
        weights = F.broadcast(weights)
    return counted.join(weights, "term").select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("score"))


def top_per_key(scores: DataFrame, key: str, item: str, score: str, k: int) -> DataFrame:
    """(key, ``phrases``), the ``k`` best items by score, then item, both descending.

    ``row_number() <= k`` is applied on each task before the shuffle, so at most
    ``k`` rows per key and task travel.
    """
    best_first = Window.partitionBy(key).orderBy(F.desc(score), F.desc(item))
    ranked = (
        scores.where(F.col(score) > 0)
        .withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") <= k)
    )
    in_order = F.sort_array(F.collect_list(F.struct("_rank", item)))
    return ranked.groupBy(key).agg(
        F.transform(in_order, lambda r: r.getField(item)).alias("phrases")
    )


def tfidf_phrases(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: DataFrame | None = None,
    stopwords: Iterable[str] = STOPWORDS,
    top_n: int = 3,
    **fit: float,
) -> DataFrame:
    """(key, phrases) for the rows that have any; ``key`` must be unique.

    Texts are cut into tokens once: the stored lists serve both counts and the scores.
    """
    tokens = vectorizer_tokens(F.col(text), stopwords).alias("tokens")
    valid = persist_reliably(df.where(is_analysable(F.col(text))).select(key, tokens))
    if vocabulary is None:
        settings = {"max_features": 1000, "max_df": 0.8, "min_df": 1, **fit}
        vocabulary = _vocabulary_of(valid.select("tokens"), **settings)
    return top_per_key(_scores_of(valid, key, vocabulary), key, "term", "score", top_n)


def attach_phrases(df: DataFrame, key: str, phrases: DataFrame, name: str) -> DataFrame:
    """Put the lists back on their rows; rows without phrases get ``[]``.

    Both sides have one row per key, so no task sees a hot key.
    """
    named = phrases.select(key, F.col("phrases").alias(name))
    return df.join(named, key, "left").withColumn(name, F.coalesce(name, empty_strings()))


# --- embedding phrases ------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def hashed_trigram_encoder(texts: list[str], dimensions: int = 256) -> np.ndarray:
    """Default encoder: counts of character trigrams hashed into ``dimensions`` cells."""
    sizes = np.array([len(t) + 2 for t in texts])
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = codes.astype(np.uint64)
    cell = (codes[:-2] * 1_000_003 + codes[1:-1] * 8_191 + codes[2:] * 131) % dimensions
    inside = owner[:-2] == owner[2:]
    flat = owner[:-2][inside] * dimensions + cell[inside].astype(np.int64)
    counts = np.bincount(flat, minlength=len(texts) * dimensions)
    return counts.reshape(len(texts), dimensions).astype(np.float64)


#: Texts encoded together hold about this many characters.
ENCODED_CHARS = 1 << 20


def _rank_candidates(
    key: str, encoder: Encoder, top_n: int, chunk: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Encode texts together, and each different candidate of all of them once, ``chunk`` at a time."""

    def cosines(texts: list[str], phrases: list[str], owners: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The cosine of each pair of a text and a phrase; ``items`` ascend. 0 for a zero vector."""
        targets = encoder(texts)
        lengths = np.linalg.norm(targets, axis=1)
        out = np.zeros(len(items))
        for first in range(0, len(phrases), chunk):
            vectors = encoder(phrases[first : first + chunk])
            own_lengths = np.linalg.norm(vectors, axis=1)
            lo, hi = np.searchsorted(items, [first, first + chunk]).tolist()
            for at in range(lo, hi, chunk):
                part = slice(at, min(at + chunk, hi))
                item, owner = items[part] - first, owners[part]
                dots = np.einsum("ij,ij->i", vectors[item], targets[owner])
                norms = own_lengths[item] * lengths[owner]
                np.divide(dots, norms, out=out[part], where=norms > 0)
        return np.round(out, 9)

    def rank_rows(rows: list[tuple]) -> Iterator[tuple]:
        number: dict[str, int] = {}
        listed: list[int] = []
        sizes: list[int] = []
        for _, _, words in rows:
            candidates = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
            listed += [number.setdefault(phrase, len(number)) for phrase in candidates]
            sizes.append(len(candidates))
        if not listed:
            return
        phrases = list(number)
        items = np.array(listed)
        order = np.argsort(items, kind="stable")
        owners, items = np.repeat(np.arange(len(rows)), sizes)[order], items[order]
        scores = cosines([text for _, text, _ in rows], phrases, owners, items)
        # The best of each text, with all that equal the last of them.
        best_first = np.lexsort((-scores, owners))
        ends = np.cumsum(sizes)
        last = np.maximum(np.minimum(ends - np.array(sizes) + top_n, ends) - 1, 0)
        least = scores[best_first[last]]
        for k in best_first[scores[best_first] >= least[owners[best_first]]].tolist():
            yield rows[owners[k]][0], phrases[items[k]], float(scores[k])

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            held: list[tuple] = []
            size = 0
            for row in zip(batch[key], batch["text"], batch["words"]):
                if held and size + len(row[1]) > ENCODED_CHARS:
                    out += rank_rows(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
            if held:
                out += rank_rows(held)
            yield pd.DataFrame(out, columns=[key, "phrase", "score"])

    return rank


def embedding_phrases(
    df: DataFrame,
    key: str,
    text: str,
    encoder: Encoder = hashed_trigram_encoder,
    stopwords: Iterable[str] = STOPWORDS,
    top_n: int = 3,
    chunk: int = 4096,
) -> DataFrame:
    """(key, phrases), the text's 1-2 grams closest to the whole text.

    Words are cut in the JVM; Python only pairs and encodes them, many rows of an Arrow
    batch at a time, on the task that holds the rows. Pairs are not shipped: they are
    many times the size of the text. The final ranking is the same as for TF-IDF.
    """
    ship_package(df.sparkSession)
    rows = df.where(is_analysable(F.col(text))).select(
        key,
        F.lower(F.col(text)).alias("text"),
        vectorizer_tokens(F.col(text), stopwords).alias("words"),
    )
    key_type = df.schema[key].dataType.simpleString()
    scored = rows.mapInPandas(
        _rank_candidates(key, encoder, top_n, chunk),
        schema=f"{key} {key_type}, phrase string, score double",
    )
    return top_per_key(scored, key, "phrase", "score", top_n)


def key_phrases(df: DataFrame, key: str, text: str, method: str = "tfidf", **options) -> DataFrame:
    """F16: the extractor is named by the caller, not picked by what is installed."""
    extractors = {"tfidf": tfidf_phrases, "embedding": embedding_phrases}
    if method not in extractors:
        raise ValueError(f"unknown method {method!r}; choose from {sorted(extractors)}")
    return extractors[method](df, key, text, **options)


def cosine_top_k(vectors: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """T2 over stored vectors: the ``k`` nearest to the one-row, one-column ``query``."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    own = F.col(vector).cast("array<double>")
    pairs = vectors.select(key, own.alias("_v"), query.scalar().cast("array<double>").alias("_q"))
    norms = F.sqrt(dot(F.col("_v"), F.col("_v"))) * F.sqrt(dot(F.col("_q"), F.col("_q")))
    scored = pairs.select(
        key, F.when(norms > 0, dot(F.col("_v"), F.col("_q")) / norms).otherwise(0.0).alias("cosine")
    )
    return scored.orderBy(F.desc("cosine"), F.asc(key)).limit(k)
