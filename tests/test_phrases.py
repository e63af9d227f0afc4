import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import phrases as ops

GOLDEN = [
    (1, "pool pool breakfast tasty", ["pool", "tasty", "pool pool"]),
    (2, "breakfast cold breakfast", ["breakfast", "cold breakfast", "cold"]),
    (3, "quiet garden pool view", ["view", "quiet garden", "quiet"]),
    (4, "short", None),
]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[:2]) for r in rows], "id long, text string")


def test_golden_phrases(spark):
    docs = frame(spark, GOLDEN)
    got = {r["id"]: r["phrases"] for r in ops.tfidf_phrases(docs, "id", "text", stopwords=()).collect()}
    assert got == {i: p for i, _, p in GOLDEN if p}
    scores = ops.term_scores(docs, "id", "text", ops.fit_vocabulary(docs, "text", ()), ())
    pool = scores.where("id = 1 AND term = 'pool'").first()
    assert pool["tf"] == 2 and pool["score"] == pytest.approx(2.575364, abs=1e-6)


def test_one_document_or_none_gives_nothing(spark):
    assert ops.tfidf_phrases(frame(spark, GOLDEN[:1]), "id", "text").count() == 0
    assert ops.tfidf_phrases(frame(spark, GOLDEN[3:]), "id", "text").count() == 0


def brute_vocabulary(texts, max_features, max_df=0.8):
    counted = []
    for t in texts:
        words = re.findall(r"\b\w\w+\b", t.lower())
        counted.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total, df = Counter(), Counter()
    for c in counted:
        total.update(c)
        df.update(c.keys())
    kept = [t for t in total if df[t] <= max_df * len(texts)]
    best = sorted(kept, key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in best}
    top = []
    for c in counted:
        scored = sorted(((c[t] * idf[t], t) for t in c if t in idf), reverse=True)[:3]
        top.append([t for _, t in scored])
    return idf, top


@pytest.mark.parametrize("k", [1, 2, 7, 100, 399, 400])
def test_kth_largest_and_smallest_by_refinement(spark, monkeypatch, k):
    monkeypatch.setattr(ops, "CELLS", 3)
    monkeypatch.setattr(ops, "MAX_SORTED_TIES", 4)
    rng = np.random.default_rng(k)
    numbers = (rng.pareto(0.7, 400) * 3).astype(np.int64).tolist()
    words = sorted({"".join(rng.choice(list("aab é漢"), rng.integers(0, 6))) for _ in range(3000)})[:400]
    rng.shuffle(words)
    assert len(words) == 400
    counts = spark.createDataFrame(list(zip(words, numbers)), "term string, total long")
    total, above = ops.kth_largest(counts, "total", k)
    ordered = sorted(numbers, reverse=True)
    assert total == ordered[k - 1] and above == sum(n > total for n in numbers)
    assert ops.kth_smallest_text(counts, "term", k) == sorted(words)[k - 1]
    expected = sorted(zip(words, numbers), key=lambda r: (-r[1], r[0]))[:k]
    assert sorted(map(tuple, ops.top_terms(counts, k).collect())) == sorted(expected)
    assert ops.kth_largest(counts, "total", 401) is None and ops.top_terms(counts, 401).count() == 400


def test_large_vocabulary_stays_a_table(spark, monkeypatch):
    monkeypatch.setattr(ops, "MAX_COLLECTED_FEATURES", 10)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}x" for i in rng.zipf(1.6, 60) if i < 300) + " padding" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for k in (11, 150, 100_000):
        idf, _ = brute_vocabulary(texts, k)
        got = {r["term"]: r["idf"] for r in ops.fit_vocabulary(docs, "text", (), max_features=k).collect()}
        assert got.keys() == idf.keys()
        assert all(got[t] == pytest.approx(idf[t], abs=1e-12) for t in idf)
    assert ops.fit_vocabulary(docs.limit(1), "text", (), max_features=50).count() == 0


@pytest.mark.parametrize("max_features", [5, 40, 10_000])
def test_pruned_counting_is_exact(spark, max_features):
    # A skewed word distribution: the first words are in most texts, and one
    # text is far longer than the others.
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    weights /= weights.sum()
    texts = [" ".join(rng.choice(words, size=int(n), p=weights)) for n in rng.integers(6, 40, 80)]
    texts.append(" ".join(rng.choice(words, size=3000, p=weights)))
    docs = frame(spark, enumerate(texts))
    idf, top = brute_vocabulary(texts, max_features)
    vocabulary = ops.fit_vocabulary(docs, "text", (), max_features=max_features)
    got = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert got == pytest.approx(idf)
    lists = {r["id"]: r["phrases"] for r in ops.tfidf_phrases(docs, "id", "text", vocabulary, ()).collect()}
    assert [lists.get(i, []) for i in range(len(texts))] == top


def test_embedding_phrases_match_brute_force(spark):
    rows = [(1, "quiet garden pool view"), (2, "cold breakfast, cold coffee"), (3, "tiny")]
    got = {r["id"]: r["phrases"] for r in ops.embedding_phrases(frame(spark, rows), "id", "text").collect()}
    assert set(got) == {1, 2}
    for i, text in rows[:2]:
        words = re.findall(r"\w\w+", text)
        grams = sorted(set(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
        vectors = ops.hashed_trigram_encoder([text, *grams])
        cosine = vectors[1:] @ vectors[0] / (np.linalg.norm(vectors[1:], axis=1) * np.linalg.norm(vectors[0]))
        best = sorted(zip(np.round(cosine, 9), grams), reverse=True)[:3]
        assert got[i] == [g for _, g in best]


def test_embedding_chunks_do_not_change_the_result(spark):
    docs = frame(spark, [(1, " ".join(f"word{i} thing{i % 7}" for i in range(200)))])
    whole = ops.embedding_phrases(docs, "id", "text").first()["phrases"]
    assert ops.embedding_phrases(docs, "id", "text", chunk=13).first()["phrases"] == whole


def test_encoder_is_a_parameter(spark):
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    docs = frame(spark, [(1, "aa bbbb cccccccc")])
    got = ops.key_phrases(docs, "id", "text", method="embedding", encoder=lengths, top_n=1)
    assert got.first()["phrases"] == ["bbbb cccccccc"]


def test_method_is_explicit(spark):
    with pytest.raises(ValueError):
        ops.key_phrases(frame(spark, GOLDEN), "id", "text", method="best")


def test_cosine_top_k(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<float>"
    )
    query = vectors.where("id = 1").select("v")
    got = ops.cosine_top_k(vectors, "id", "v", query, 3).collect()
    assert [r["id"] for r in got] == [1, 2, 3]
    assert got[0]["cosine"] == pytest.approx(1.0)


def test_attach_keeps_rows_without_phrases(spark):
    docs = frame(spark, GOLDEN)
    out = ops.attach_phrases(docs, "id", ops.tfidf_phrases(docs, "id", "text", stopwords=()), "p")
    assert {r["id"]: r["p"] for r in out.collect()}[4] == []
    assert out.where(F.col("p").isNull()).count() == 0


def test_user_vocabulary_with_quotes(spark):
    vocabulary = spark.createDataFrame([("it's", 1, 1, 1.0), ("pool", 1, 1, 2.0), ("a\\b", 1, 1, 1.0)], ops.VOCABULARY_SCHEMA)
    scores = ops.term_scores(frame(spark, GOLDEN), "id", "text", vocabulary, ())
    assert {(r["id"], r["tf"]) for r in scores.collect()} == {(1, 2), (3, 1)}
