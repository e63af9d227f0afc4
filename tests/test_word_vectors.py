"""The trained encoder against dense arithmetic."""

import re
from collections import Counter

import numpy as np
import pytest

from reviewlake.operators import phrases, word_vectors as wv

VOCABULARY = [f"word{i}" for i in range(60)]


def texts(seed, n=80):
    rng = np.random.default_rng(seed)
    topics = [rng.choice(VOCABULARY, 12, replace=False) for _ in range(5)]
    out = [" ".join(rng.choice(topics[rng.integers(5)], rng.integers(2, 40))) for _ in range(n)]
    return [*out, None, "", "tiny", "word1 " * 300, "other " * 4 + "unseen words here"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "id long, text string, tokens string")


def plain_table(rows, words, window):
    counts = Counter()
    for text in rows:
        if text and len(text.strip()) > 10:
            tokens = re.findall(r"\w\w+", text)
            for i, a in enumerate(tokens):
                for b in tokens[i + 1 : i + 1 + window]:
                    if a in words and b in words:
                        counts[tuple(sorted((a, b)))] += 1
    place = {w: i for i, w in enumerate(words)}
    table = np.zeros((len(words), len(words)))
    for (a, b), n in counts.items():
        table[place[a], place[b]] += n
        table[place[b], place[a]] += n
    margins = table.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        information = np.log(table * margins.sum() / np.outer(margins, margins))
    return counts, np.where(table > 0, np.maximum(information, 0), 0)


def fit(spark, docs, **options):
    return wv.fit_word_vectors(docs, "text", (), **options)


@pytest.mark.parametrize("window,k", [(1, 60), (4, 60), (4, 25)])
def test_associations_equal_plain_counting(spark, window, k):
    rows = texts(window)
    tokens = wv.token_lists(frame(spark, rows), "text", ())
    words = wv.frequent_words(tokens, k)
    pairs = wv.cooccurrences(tokens, words, window)
    counts, table = plain_table(rows, words, window)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == counts
    place = {w: i for i, w in enumerate(words)}
    got = {(r["a"], r["b"]): r["ppmi"] for r in wv.positive_information(pairs).collect()}
    expected = {(a, b): table[place[a], place[b]] for a, b in counts if table[place[a], place[b]] > 0}
    assert got == pytest.approx(expected, abs=1e-12)


def test_vectors_are_the_leading_eigenvectors(spark):
    rows = texts(7)
    encoder = fit(spark, frame(spark, rows), dimensions=6, iterations=12)
    _, table = plain_table(rows, encoder.words, wv.WINDOW)
    values, vectors = np.linalg.eigh(table)
    order = np.argsort(-np.abs(values))[:6]
    assert encoder.weights == pytest.approx(values[order], rel=1e-4)
    lengths = np.linalg.norm(encoder.matrix, axis=0)
    assert lengths == pytest.approx(np.sqrt(np.abs(values[order])), rel=1e-4)
    alike = np.abs((encoder.matrix / lengths * vectors[:, order]).sum(axis=0))
    assert alike == pytest.approx(np.ones(6), abs=1e-3)


def test_partitions_do_not_change_a_bit(spark):
    docs = frame(spark, texts(3))
    one, other = (fit(spark, docs.repartition(n), dimensions=5) for n in (1, 7))
    assert one.words == other.words and np.array_equal(one.matrix, other.matrix)


def test_words_of_one_topic_are_near(spark):
    rng = np.random.default_rng(1)
    topics = [[f"sea{i}" for i in range(8)], [f"city{i}" for i in range(8)]]
    rows = [" ".join(rng.choice(topics[i % 2], 30)) for i in range(60)]
    encoder = fit(spark, frame(spark, rows), dimensions=4)
    sea, sea2, city = encoder(["sea0", "sea1", "city1"])

    def cosine(a, b):
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    assert cosine(sea, sea2) > 0.5 > cosine(sea, city) + 0.3


def test_phrases_equal_brute_force(spark):
    rows = texts(5, 30)
    docs = frame(spark, rows)
    encoder = fit(spark, docs, dimensions=8)
    found = phrases.key_phrases(docs, "id", "text", method="embedding", encoder=encoder, stopwords=())
    got = {r["id"]: r["phrases"] for r in found.collect()}
    place = {w: i for i, w in enumerate(encoder.words)}
    for i, text in enumerate(rows):
        if not text or len(text.strip()) <= 10:
            assert i not in got
            continue
        words = re.findall(r"\w\w+", text)
        vector = {g: sum(encoder.matrix[place[w]] for w in g.split()) for g in {*words, *map(" ".join, zip(words, words[1:]))}}
        whole = sum(encoder.matrix[place[w]] for w in words)
        cosine = {g: v @ whole / (np.linalg.norm(v) * np.linalg.norm(whole)) for g, v in vector.items()}
        lowest = sorted((c for c in cosine.values() if c > 0), reverse=True)[:3]
        assert [cosine[g] for g in got[i]] == pytest.approx(lowest, abs=1e-8)


def test_odd_input(spark):
    docs = frame(spark, [None, "", "a b c d e f g h"])
    encoder = fit(spark, docs)
    assert encoder(["anything"]).shape == (1, 0)
    assert phrases.embedding_phrases(docs, "id", "text", encoder=encoder).count() == 0
    assert fit(spark, docs.limit(0)).words == ()
    with pytest.raises(ValueError):
        fit(spark, docs, max_words=0)
    # A word that stands beside itself only tells nothing: log 1.
    assert fit(spark, frame(spark, ["lonely lonely lonely"]), dimensions=1)(["lonely x"]).shape == (1, 0)


def test_long_texts_are_added_in_pieces(spark, monkeypatch):
    encoder = wv.WordVectors(("aa", "bb"), np.array([[1.0, 0], [0, 1.0]]), np.zeros(2))
    given = ["aa " * 10, "none", "bb aa", ""]
    whole = encoder(given)
    monkeypatch.setattr(wv, "CHUNK_WORDS", 3)
    assert np.array_equal(encoder(given), whole) and whole.tolist() == [[10, 0], [0, 0], [1, 1], [0, 0]]
