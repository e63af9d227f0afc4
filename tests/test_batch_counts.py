"""Counts of Arrow batches against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.text import letter_trigrams
from reviewlake.operators import batch_counts as bc, language as lang, phrases as ph

LISTS = [["a", "b", "a", "b"], [], ["é", "b"], None, ["b"] * 5, ["漢", "a", "b"], ["b", "a"]]


@pytest.fixture(params=[1 << 22, 1])
def cells(request, monkeypatch):
    """Numbers are found by a table and by sorting alike."""
    monkeypatch.setattr(bc, "MAX_CELLS", request.param)


def grams(words, known=None):
    return [f"{a} {b}" for a, b in zip(words, words[1:]) if known is None or {a, b} <= known]


def tokens(spark):
    return spark.createDataFrame([(i % 5 or None, t) for i, t in enumerate(LISTS)], "id long, tokens array<string>")


def test_slices():
    sizes = bc.np.array([4, 4, 4, 30, 0, 0, 1])
    assert list(bc.slices(sizes, 10)) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(bc.slices(sizes[:0], 10)) == []


def test_numbers(cells):
    values = bc.np.array([7, 3, 7, 0])
    distinct, places = bc.numbered(values, 8)
    assert distinct.tolist() == [0, 3, 7] and places.tolist() == [2, 1, 2, 0]
    row, number, count = bc.row_counts(bc.np.array([0, 0, 2, 0]), bc.np.array([1, 1, 0, 0]), 2)
    assert list(zip(row.tolist(), number.tolist(), count.tolist())) == [(0, 0, 1), (0, 1, 2), (2, 0, 1)]


def test_term_stats(spark):
    rows = [t or [] for t in LISTS]
    for pairs, among in ((False, None), (True, None), (True, ["a", "b"])):
        made = [grams(t, among and set(among)) if pairs else t for t in rows]
        total, df = Counter(g for m in made for g in m), Counter(g for m in made for g in set(m))
        got = {r["term"]: (r["total"], r["df"]) for r in bc.term_stats(tokens(spark).repartition(3), pairs, among).collect()}
        assert got == {g: (total[g], df[g]) for g in total}


def test_row_terms(spark):
    for listed in (None, ["a", "b a", "é b", "none"]):
        expected = Counter(
            (i % 5 or None, g, n)
            for i, t in enumerate(LISTS)
            for g, n in Counter([*(t or []), *grams(t or [])]).items()
            if listed is None or g in listed
        )
        assert Counter(tuple(r) for r in bc.row_terms(tokens(spark), "id", listed).collect()) == expected


def test_trigrams_are_those_of_the_expression(spark):
    texts = ["The cat!", "", None, "  Ünï 漢字 x", "...", "a\nb", "word " * 40, "cat the"]
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    plain = df.select("id", "lang", F.explode(letter_trigrams(F.col("text"))).alias("t")).collect()
    got = {(r["lang"], r["trigram"]): r["n"] for r in bc.language_trigrams(df.repartition(2), "text", "lang").collect()}
    assert got == Counter((r["lang"], r["t"]) for r in plain)
    profile = spark.createDataFrame([("the", 3, 1), (" ca", 10, 0), ("漢字 ", 5, 5), ("no", 9, 9)], "trigram string, _g0 long, _g1 long")
    gains = {r["trigram"]: (r["_g0"], r["_g1"]) for r in profile.collect()}
    expected = {}
    for r in plain:
        n, a, b = expected.get(r["id"], (0, 0, 0))
        x, y = gains.get(r["t"], (0, 0))
        expected[r["id"]] = (n + 1, a + x, b + y)
    sums = bc.trigram_sums(df, "id", "text", profile.toArrow(), 2).collect()
    assert {r["id"]: tuple(r)[1:] for r in sums} == expected


def test_no_row_is_counted_by_an_interpreted_lambda(spark):
    """A lambda for each token or letter took most of the time of the counts."""
    docs = spark.createDataFrame([(i, "x", f"some words of text number{i} again") for i in range(4)], "id long, lang string, text string")
    profiles = lang.fit_language_profiles(docs, "text", "lang")
    vocabulary = ph.fit_vocabulary(docs, "text")
    for made in (lang.detect_language(docs, "id", "text", profiles), bc.term_stats(docs.select(F.split("text", " ").alias("tokens")), True)):
        assert "lambda" not in made._jdf.queryExecution().analyzed().toString()
    scores = ph.term_scores(docs, "id", "text", vocabulary)
    plan = scores._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and not re.search(r"transform\(|sequence\(", plan)


def test_one_task_writes_a_bounded_file(spark, sf_dir, monkeypatch):
    from reviewlake.catalog import storage

    monkeypatch.setattr(storage, "ONE_FILE_BYTES", 1 << 16)
    paths = []
    path = storage._path
    monkeypatch.setattr(storage, "_path", lambda spark, name: paths.append(path(spark, name)) or paths[-1])
    got = storage.csv_scan_one_file(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert texts == {r["doc_id"]: r["text"].replace(".", '."\n",') for r in docs.collect()}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths[0]).select("length").collect()
    assert len(files) > 1 and max(f["length"] for f in files) < 1 << 19
