"""The physical plans keep the properties the operators promise."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from reviewlake.catalog import QUERIES
from reviewlake.operators import dashboard, dedup, frontier, phrases
from reviewlake.operators.tokens import corpus_vocabulary
from reviewlake.functions.text import ascii_tokens


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(entry_points.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_row_local_work_does_not_shuffle(docs):
    vocabulary = phrases.fit_vocabulary(docs, "text")
    scores = plan(phrases.term_scores(docs, "doc_id", "text", vocabulary))
    assert "Exchange hash" not in scores and "BroadcastHashJoin" in scores


def test_top_phrases_rank_before_the_shuffle(docs):
    text = plan(phrases.tfidf_phrases(docs, "doc_id", "text"))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange hashpartitioning") == 1


def test_limit_per_key_ranks_before_the_shuffle(docs):
    text = plan(frontier.limit_per_key(docs, "source", 2, F.asc("doc_id")))
    assert text.count("WindowGroupLimit") == 2


def test_append_is_one_shuffle(docs):
    batch = docs.select("doc_id", "lang", "source", "n_chars")
    text = plan(dedup.new_rows(batch, docs.select("lang", "source"), ["lang", "source"], "doc_id"))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("null_safe", [True, False])
def test_rows_are_ranked_not_aggregated(docs, null_safe):
    batch = docs.select("doc_id", "lang", "source", "n_chars")
    appended = dedup.new_rows(batch, docs.select("lang", "source"), ["lang", "source"], "doc_id", null_safe)
    for df in (appended, dedup.dedup_rows(batch, ["lang", "source"], "doc_id")):
        text = plan(df)
        assert "SortAggregate" not in text and text.count("WindowGroupLimit") == 2


def test_scans_read_only_what_is_used(docs):
    text = plan(dashboard.filter_in(docs, {"lang": ["fr"], "source": ["src1"]}).select("doc_id"))
    assert "PushedFilters: [In(lang" in text or "EqualTo(lang,fr)" in text
    assert "text" not in text.split("ReadSchema")[1]
    words = plan(corpus_vocabulary(docs, ascii_tokens(F.col("text"))))
    assert words.split("ReadSchema: ")[1].strip().startswith("struct<text:string>")


def test_tokens_are_cut_once(spark, sf_dir):
    for name in ("row_domain_tokens", "drop_without_tokens", "preview_tokens", "sentiment_slice"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("regexp_extract_all") == 1, name


def test_words_are_tested_before_the_distinct(spark, sf_dir):
    for name in ("token_categories", "domain_tokens_of_corpus"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("Scan parquet") == 1, name
        assert text.index("HashAggregate") < text.index("array_intersect"), name


def test_profile_cleans_each_text_once_and_stores_none(spark, sf_dir):
    text = plan(QUERIES["data_quality_profile"](spark, sf_dir))
    assert "documents.parquet" in text and "stage-" not in text
    stored = [c for c in ("positive_review", "negative_review") if f"partial_count({c}" in text]
    assert len(stored) == 2 and text.count("b(can(?=not") == 2
