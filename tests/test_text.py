import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import labels, text as tx
from reviewlake.functions.arrays import array_length, array_literal, item, members, run_lengths
from reviewlake.lexicons import (
    CATEGORY_TERMS,
    HOTEL_STOPWORDS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    STOPWORDS,
    category_frame,
    literal_words,
    read_word_list,
)


def column(spark, values, expression, schema="i int, c string"):
    rows = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("c"))).collect()]


GOLDEN = [
    ("No Positive Feedback", "no positive feedback", "positive feedback"),
    ("  GREAT pool!!  5 stars ", "great pool stars", "great pool stars"),
    ("I cannot sleep!!", "i cannot sleep", "sleep"),
    ("Don't go", "don t go", "go"),
    ("Привет", "", ""),
    ("café", "caf", "caf"),
    (None, "none", "none"),
    ("", "", ""),
    ("gonna go", "gonna go", "gon na go"),
]


def test_clean_text_and_stopwords_parity(spark):
    inputs = [g[0] for g in GOLDEN]
    assert column(spark, inputs, lambda c: tx.clean_text(c, parity=True)) == [g[1] for g in GOLDEN]
    both = lambda c: tx.remove_stopwords(tx.clean_text(c, parity=True))
    assert column(spark, inputs, both) == [g[2] for g in GOLDEN]


def test_null_stays_null_by_default(spark):
    assert column(spark, [None], lambda c: tx.remove_stopwords(tx.clean_text(c))) == [None]
    assert column(spark, ["", "x"], tx.mark_empty) == [None, "x"]
    assert column(spark, ["", "x"], lambda c: tx.mark_empty(c, parity=True)) == ["0", "x"]


def _two_step(text):
    text = re.sub(r"[^a-zA-Z\s]", " ", text)
    return re.sub(r"\s{2,}", " ", text).strip().lower()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é .\n\t  \x1c!", max_size=12), min_size=1, max_size=30))
def test_one_pass_cleaning_equals_two_steps(spark, texts):
    assert column(spark, texts, tx.clean_text) == [_two_step(t) for t in texts]


def test_city_duration_date(spark):
    cities = ["Hotels in Cairo, near Luxor road", "Giza", None, "SHARM el sheikh"]
    assert column(spark, cities, tx.normalize_city) == ["Luxor", None, None, "Sharm El Sheikh"]
    assert column(spark, ["3 nights · ", "1 night,"], tx.clean_duration) == ["3 nights   ", "1 night "]
    assert column(spark, [None], lambda c: tx.clean_duration(c, parity=True)) == ["None"]
    dates = ["Reviewed: 12 March 2024", "Reviewed:12"]
    assert column(spark, dates, tx.clean_review_date) == ["12 March 2024", "Reviewed:12"]


def test_tokens(spark):
    text = "café wifi5 pool a_b spa x"
    assert column(spark, [text], tx.ascii_tokens) == [["pool", "spa", "x"]]
    assert column(spark, ["Bad, bad room. Dirty!"], tx.word_tokens) == [["bad", "bad", "room", "dirty"]]
    grams = column(spark, ["The pool was very cold"], lambda c: tx.unigrams_and_bigrams(tx.vectorizer_tokens(c)))
    assert grams == [["pool", "cold", "pool cold"]]
    assert column(spark, [""], lambda c: tx.bigrams(tx.vectorizer_tokens(c))) == [[]]


def test_letter_trigrams(spark):
    assert column(spark, ["the cat!", "", None], tx.letter_trigrams) == [
        [" th", "the", "he ", " ca", "cat", "at "], [], None,
    ]


def test_run_lengths(spark):
    split = lambda c: run_lengths(F.split(c, " "))
    found = column(spark, ["b a b", "a"], split)
    assert [[tuple(x) for x in row] for row in found] == [[("a", 1), ("b", 2)], [("a", 1)]]
    assert column(spark, [None, "x"], lambda c: run_lengths(tx.ascii_tokens(c)))[0] in (None, [])


@pytest.mark.parametrize(
    "negative, positive, parity_code, code",
    [
        ("dirty", "great pool", -1, -1),
        ("dirty", "0", 0, 0),
        ("dirty", "positive feedback", -1, 0),
        ("negative feedback", "great pool", 1, 1),
        ("negative feedback", "positive feedback", 1, 2),
        ("nothing", "0", 2, 2),
        (None, "great", 1, 1),
    ],
)
def test_sentiment(spark, negative, positive, parity_code, code):
    row = spark.createDataFrame([(negative, positive)], "n string, p string")
    n, p = F.col("n"), F.col("p")
    got = row.select(
        labels.classify_sentiment(n, p, parity=True), labels.classify_sentiment(n, p)
    ).first()
    assert tuple(got) == (parity_code, code)


def test_labels_and_ratio(spark):
    codes = spark.createDataFrame([(c,) for c in (1, -1, 0, 2, None)], "c int")
    got = codes.select(
        labels.sentiment_label(F.col("c"), parity=True), labels.sentiment_label(F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Positive", "Positive"), ("Negative", "Mixed"), (None, "Negative"), (None, "Empty"), (None, None),
    ]
    one = spark.range(1).select(
        labels.ratio_percent(F.lit(1), F.lit(4)), labels.ratio_percent(F.lit(1), F.lit(0))
    )
    assert tuple(one.first()) == (25.0, 0.0)


def test_season(spark):
    months = [f"2024-{m:02d}-15" for m in range(1, 13)]
    got = column(spark, months, lambda c: labels.season(F.to_date(c)))
    assert got == ["Dec-Feb"] * 3 + ["Mar-May"] * 3 + ["Jun-Aug"] * 3 + ["Sep-Nov"] * 3


def test_arrays(spark):
    row = spark.createDataFrame([(["b", 'a"x'], [])], "a array<string>, e array<string>")
    got = row.select(
        array_literal(F.col("a")), array_literal(F.col("e")), array_length(F.col("a")),
        array_length(F.col("e")), item(F.col("a"), 1), item(F.col("a"), 3),
        members(F.array(F.lit("z"), F.lit("b"), F.lit("b")), ["b", "a", "z"]),
    ).first()
    assert tuple(got) == ('{"b","a""x"}', None, 2, None, "b", None, ["b", "z"])


def test_word_lists(spark, tmp_path):
    assert (len(NEGATIVE_WORDS), len(POSITIVE_WORDS), len(HOTEL_STOPWORDS)) == (21, 20, 27)
    assert sum(map(len, CATEGORY_TERMS.values())) == 67
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 179
    (tmp_path / "words.txt").write_text("# list\nPool\n\nbeach\npool\n")
    assert read_word_list(str(tmp_path / "words.txt")) == ["beach", "pool"]
    with pytest.raises(ValueError):
        literal_words(str(i) for i in range(30_000))
    twice = category_frame(spark, {"one": ["a", "b"], "two": ["b"]})
    assert {(r["token"], r["category"]) for r in twice.collect()} == {("a", "one"), ("b", "one")}
