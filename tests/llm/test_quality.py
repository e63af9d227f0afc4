"""Word vectors against plain counting, the network, and held-out accuracy."""

import numpy as np

from reviewlake.llm import quality, queries


def test_contexts_equal_plain_counting():
    texts = ["one two three two $$$", "", "a", "two, one!! two", "x " * 300]
    rows, offsets = quality.word_rows(texts)
    table = np.zeros((quality.ROWS, quality.DIMENSIONS), dtype=np.int64)
    quality.add_contexts(table, rows, offsets)
    expected, vectors = np.zeros_like(table), quality.index_vectors()
    for a, b in zip(offsets, offsets[1:]):
        for i in range(a, b):
            for j in range(max(a, i - quality.CONTEXT), min(b, i + quality.CONTEXT + 1)):
                if i != j:
                    expected[rows[i]] += vectors[rows[j]]
    assert (table == expected).all()
    assert np.diff(offsets).tolist() == [5, 0, 1, 5, 300]


def test_pooling_equals_plain_statistics():
    vectors = np.random.default_rng(1).normal(size=(quality.ROWS, quality.DIMENSIONS)).astype(np.float32)
    texts = ["one two three", "", "again again"]
    got = quality.pooled(texts, vectors)
    rows, offsets = quality.word_rows(texts)
    first = vectors[rows[offsets[0] : offsets[1]]]
    n = quality.DIMENSIONS
    assert np.allclose(got[0], [*first.mean(axis=0), *first.std(axis=0), np.log(4)], atol=1e-3)
    assert (got[1] == 0).all() and np.allclose(got[2, n:-1], 0, atol=1e-3)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 20))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    net = quality.train(x, y)
    fresh = rng.normal(size=(3000, 20))
    truth = rng.random(3000) < 1 / (1 + np.exp(-3 * fresh[:, 0] * fresh[:, 1]))
    scores = net.scores(fresh)
    assert ((scores > 0.5) == truth).mean() > 0.65
    high = scores > 0.8
    assert abs(scores[high].mean() - truth[high].mean()) < 0.15


def test_few_labels():
    nothing = quality.train(np.zeros((0, 5)), np.zeros(0))
    assert np.allclose(nothing.scores(np.ones((2, 5))), 0.5)
    same = quality.train(np.ones((4, 5)), np.ones(4))
    assert (same.scores(np.zeros((2, 5))) > 0.9).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_quality_score"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 40
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    above = (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean()
    assert above > 0.95, above
    assert (held.predicted == held.quality).mean() > 0.9


def test_odd_rows(spark):
    texts = [None, "", "good words here", "bad $$$ words !!", "漢字 🎉", "w " * 50_000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (2, texts[2], "c")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (4, 1), (None, 1), (5, None), (99, 1), (0, 5)], "doc_id long, label int")
    vectors = quality.fit_vectors(docs)
    scored = quality.score(docs, vectors, quality.fit_network(docs, labels, vectors)).collect()
    assert len(scored) == 8 and all(0 <= r["score"] <= 1 for r in scored)
    none = docs.limit(0)
    vectors = quality.fit_vectors(none)
    assert quality.score(none, vectors, quality.fit_network(none, labels.limit(0), vectors)).count() == 0
