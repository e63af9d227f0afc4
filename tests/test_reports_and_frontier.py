import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlake import lexicons
from reviewlake.lexicons import CATEGORY_TERMS, DOMAIN_VOCABULARY, word_frame
from reviewlake.operators import dashboard, frontier, metrics, tokens

LINKS = [("a", True), ("b", False), ("c", None), ("d", None)]


def links(spark):
    return spark.createDataFrame(LINKS, "link string, is_scraped boolean")


def test_queue(spark):
    assert {r["link"] for r in frontier.pending_links(links(spark)).collect()} == set("bcd")
    tried = spark.createDataFrame([("b", True), ("b", False), ("c", False)], "link string, ok boolean")
    marked = {r["link"]: (r["is_scraped"], r["status"]) for r in frontier.mark_done(links(spark), tried).collect()}
    assert marked == {"a": (True, None), "b": (True, "done"), "c": (None, "failed"), "d": (None, None)}


def test_statistics(spark):
    reviews = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23, 59),), (dt.datetime(2024, 1, 2),), (None,)], "scraped_at timestamp"
    )
    row = frontier.crawl_statistics(reviews, links(spark), day=F.lit("2024-01-02")).first()
    assert tuple(row) == (1, 3, 1, 4, 3, 25.0)
    empty = frontier.crawl_statistics(reviews.limit(0), links(spark).limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0.0)


def test_run_limits():
    assert frontier.run_limits("quarterly") == (None, None)
    assert frontier.run_limits("daily") == (10, 5)
    with pytest.raises(ValueError):
        frontier.run_limits("hourly")


def test_limits_and_samples(spark):
    pages = spark.range(100).select((F.col("id") % 3).alias("h"), "id")
    assert frontier.limit_per_key(pages, "h", None, F.asc("id")).count() == 100
    kept = frontier.limit_per_key(pages, "h", 2, F.asc("id"))
    assert {r["id"] for r in kept.collect()} == set(range(6))
    one = [r["id"] for r in frontier.shuffled_limit(pages, "id", 10, seed=1).collect()]
    assert one == [r["id"] for r in frontier.shuffled_limit(pages.repartition(9), "id", 10, seed=1).collect()]
    assert one != [r["id"] for r in frontier.shuffled_limit(pages, "id", 10, seed=2).collect()]
    assert frontier.shuffled_limit(pages, "id", None).count() == 100


def test_session_and_status(spark):
    outcome = spark.createDataFrame([(True,), (True,), (False,), (None,)], "ok boolean")
    assert tuple(frontier.session_outcome(outcome, "ok").first()) == (3, 1, 2, pytest.approx(200 / 3))
    assert tuple(frontier.session_outcome(outcome, "ok", max_links=2).first()) == (2, 1, 1, 50.0)
    assert tuple(frontier.session_outcome(outcome.limit(0), "ok").first()) == (0, 0, 0, 0.0)
    cases = spark.createDataFrame([(0, 0), (1, 5), (1, 0)], "f int, r int")
    got = [r[0] for r in cases.select(metrics.crawl_status(F.col("f"), F.col("r"))).collect()]
    assert got == ["SUCCESS", "PARTIAL SUCCESS", "FAILED"]


def test_reports(spark):
    source = spark.range(4)
    translated = spark.createDataFrame([("a", None), (None, None)], "n string, p string")
    row = metrics.translation_report(source, translated, "n", "p").first()
    assert tuple(row) == (4, 2, 1, 50.0, "SUCCESS")
    assert metrics.translation_report(source, translated.limit(0), "n", "p").first()["status"] == "FAILED"
    gold = spark.createDataFrame([(["a", "b"], None), (["c"], ["d"])], "positive_tokens array<string>, negative_tokens array<string>")
    row = metrics.gold_report(source, gold, gold.limit(1)).first()
    assert row.asDict() == {"source_rows": 4, "final_rows": 2, "ingested_rows": 1, "positive_tokens": 3,
                            "negative_tokens": 1, "status": "SUCCESS"}


def test_audits(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 5), ["a"]), (dt.datetime(2024, 1, 1, 9), None), (None, ["a", "b"])],
        "at timestamp, t array<string>",
    )
    audit = metrics.load_audit(rows, "at").first()
    assert (audit["total_records"], audit["distinct_load_dates"]) == (3, 1)
    assert tuple(metrics.array_audit(rows, "t").first()) == ("t", 2, 1, 2)
    assert metrics.null_profile(rows, "at").first()["missing"] == 1
    bad = metrics.reconcile(spark.range(2), spark.range(4), spark.range(3)).first()
    assert tuple(bad) == (2, 4, 2, 3, False)


def test_dashboard(spark):
    df = spark.createDataFrame(
        [("Cairo", "h1", "Bad, bad room. Dirty!"), ("Cairo", "h2", "No Negative Feedback"), ("Luxor", "h3", None), (None, "h4", "old")],
        "city string, hotel string, neg string",
    )
    assert dashboard.filter_in(df, {"city": [], "hotel": None}).count() == 4
    assert dashboard.filter_in(df, {"city": ["Cairo"], "hotel": ["h1", "h3"]}).count() == 1
    assert {r["hotel"] for r in dashboard.distinct_choices(df, "hotel", {"city": ["Cairo"]}).collect()} == {"h1", "h2"}
    assert dashboard.distinct_choices(df, "city").count() == 3
    kept = dashboard.drop_sentinel(df, "neg", "no negative feedback")
    top = [tuple(r) for r in dashboard.keyword_topk(kept, "neg", ["bad", "dirty", "old", "cold"]).collect()]
    assert top == [("bad", 2), ("dirty", 1), ("old", 1)]
    assert [tuple(r) for r in dashboard.value_counts(df, "city").collect()] == [("Cairo", 2), ("Luxor", 1)]


def test_season_filter(spark):
    rows = spark.createDataFrame([("Dec-Feb",), ("Mar-May",), ("Jun-Aug",), (None,)], "s string")
    pick = lambda target: {r["s"] for r in frontier.filter_season(rows, "s", target).collect()}
    assert pick("mar-may") == {"Mar-May"}
    assert pick("Mar-May 2024") == {"Mar-May"}
    assert pick("Feb-Jun") == {"Dec-Feb", "Jun-Aug"}
    assert pick("spring") == set()


def test_token_operators(spark):
    df = spark.createDataFrame([(["pool", "hotel", "ab", "the"], ["dirty"]), (["zz", "wine"], [])], "a array<string>, b array<string>")
    corpus = tokens.corpus_vocabulary(df, F.col("a"), names=["Wine"])
    assert {r["token"] for r in corpus.collect()} == {"pool"}
    row = df.select(tokens.row_domain_tokens(F.col("a"), ["pool", "hotel", "wine", "ab"]).alias("x")).collect()
    assert [r["x"] for r in row] == [["pool"], ["wine"]]
    assert tokens.drop_without_tokens(df.withColumn("a", F.array().cast("array<string>")), "a", "b").count() == 1
    assert tokens.sentiment_slice(df.withColumn("c", F.lit(-1)), -1, "b", "c").count() == 1
    every = spark.createDataFrame([(list(terms),) for terms in CATEGORY_TERMS.values()], "t array<string>")
    found = {r["category"]: r for r in tokens.token_categories(every, F.col("t")).collect()}
    assert len(found) == 7 and found["accommodation"]["n_tokens"] == 12
    assert found["accommodation"]["first_tokens"] == sorted(CATEGORY_TERMS["accommodation"])[:10]
    assert {r["token"] for r in tokens.domain_tokens_of_corpus(every, F.col("t")).collect()} <= set(DOMAIN_VOCABULARY)
    phrases = spark.createDataFrame([(["cold pool", "spa5"],)], "p array<string>")
    assert phrases.select(tokens.phrase_tokens(F.col("p"))).first()[0] == ["cold", "pool"]


def test_default_vocabulary_keeps_every_domain_word(spark):
    assert len(set(DOMAIN_VOCABULARY)) >= 215 and {"wifi", "menu", "garden", "airport"} <= set(DOMAIN_VOCABULARY)
    df = spark.createDataFrame([(1, ["wifi"], []), (2, ["zzz"], [])], "id int, a array<string>, b array<string>")
    found = df.select("id", *[tokens.row_domain_tokens(F.col(c)).alias(c) for c in "ab"])
    assert [r["id"] for r in tokens.drop_without_tokens(found, "a", "b").collect()] == [1]


def test_long_word_lists_are_joined(spark, monkeypatch):
    rows = [(1, ["pool", "wifi", "pool"]), (2, ["zzz"]), (3, [])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    words = ["pool", "wifi", *(f"w{i}" for i in range(25_000))]
    found = tokens.domain_tokens_by_table(df, "id", "t", word_frame(spark, words), "x")
    assert {r["id"]: r["x"] for r in found.collect()} == {1: ["pool", "wifi"], 2: [], 3: []}
    corpus = tokens.domain_tokens_of_corpus(df, F.col("t"), words)
    assert {r["token"] for r in corpus.collect()} == {"pool", "wifi"}
    assert lexicons.MAX_LITERAL_WORDS < len(words)
