"""P5, P6, P11, A3-A5, A12, T1, F8, F9."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import (
    SQL_REVIEWS,
    joined,
    query,
    reviews,
    silver,
    sql_cleaned,
    sql_in,
    sql_list,
    sql_words,
    table,
)
from reviewlake.functions.labels import sentiment_label
from reviewlake.functions.text import word_tokens
from reviewlake.lexicons import NEGATIVE_WORDS
from reviewlake.operators import dashboard

CUSTOM_WORDS = ["new", "large", "hot", "red", "blue"]
FUNCTION_WORDS = ["the", "and", "of", "to", "que", "les", "der", "und", "los", "una"]


def _keyword_sql(words) -> str:
    return f"""SELECT keyword, count(*) AS frequency FROM (
  SELECT unnest(list_filter({sql_words('p_name')}, lambda w: list_contains({sql_list(words)}, w))) AS keyword
  FROM lineitem JOIN part ON l_partkey = p_partkey)
GROUP BY keyword ORDER BY frequency DESC, keyword LIMIT 10"""


def _keywords(spark, sf_dir, words):
    # Sales per part are counted before the join: a best seller is one row, and
    # the text of a part is split once.
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("sold"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = sold.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return dashboard.keyword_topk(named, "p_name", words, weight=F.col("sold"))


@query("keyword_topk_negative", _keyword_sql(NEGATIVE_WORDS))
def keyword_topk_negative(spark, sf_dir):
    return _keywords(spark, sf_dir, NEGATIVE_WORDS)


@query("keyword_topk_custom_list", _keyword_sql(CUSTOM_WORDS))
def keyword_topk_custom_list(spark, sf_dir):
    return _keywords(spark, sf_dir, CUSTOM_WORDS)


@query(
    "keyword_topk_documents",
    f"""SELECT keyword, count(*) AS frequency FROM (
  SELECT unnest(list_filter({sql_words('text')}, lambda w: list_contains({sql_list(FUNCTION_WORDS)}, w)))
    AS keyword FROM documents)
GROUP BY keyword ORDER BY frequency DESC, keyword LIMIT 10""",
)
def keyword_topk_documents(spark, sf_dir):
    return dashboard.keyword_topk(table(spark, sf_dir, "documents"), "text", FUNCTION_WORDS)


@query(
    "word_tokens",
    f"""SELECT doc_id, len(l)::INTEGER AS n_tokens, array_to_string(l, ' ') AS tokens
FROM (SELECT doc_id, {sql_words('text')} AS l FROM documents)""",
)
def word_token_list(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", word_tokens(F.col("text")).alias("l"))
    return tokens.select("doc_id", F.size("l").alias("n_tokens"), joined("l", " ").alias("tokens"))


@query(
    "feedback_without_sentinel",
    f"""WITH {SQL_REVIEWS} SELECT id, negative_review FROM reviews
WHERE negative_review IS NOT NULL AND lower(negative_review) <> 'no negative feedback'""",
)
def feedback_without_sentinel(spark, sf_dir):
    kept = dashboard.drop_sentinel(reviews(spark, sf_dir), "negative_review", "No Negative Feedback")
    return kept.select("id", "negative_review")


def _labelled(spark, sf_dir, parity):
    cleaned = silver(spark, sf_dir, "travel_type", "sentiment_classification", parity=parity)
    label = sentiment_label(F.col("sentiment_classification"), parity=parity)
    return cleaned.withColumn("sentiment", label)


_LABEL = """CASE sentiment_classification WHEN 1 THEN 'Positive' WHEN 0 THEN 'Negative'
  WHEN -1 THEN 'Mixed' WHEN 2 THEN 'Empty' END"""
_PARITY_LABEL = "CASE sentiment_classification WHEN 1 THEN 'Positive' WHEN -1 THEN 'Negative' END"


def _by_travel_type_sql(parity: bool) -> str:
    return f"""WITH {sql_cleaned(parity)},
labelled AS (SELECT travel_type, {_PARITY_LABEL if parity else _LABEL} AS sentiment FROM cleaned)
SELECT travel_type, sentiment, count(*) AS review_count FROM labelled
WHERE travel_type IS NOT NULL AND sentiment IS NOT NULL GROUP BY travel_type, sentiment"""


@query("sentiment_by_travel_type", _by_travel_type_sql(False))
def sentiment_by_travel_type(spark, sf_dir):
    return dashboard.counts_by(
        _labelled(spark, sf_dir, False), "travel_type", "sentiment", name="review_count"
    )


@query("sentiment_by_travel_type_parity", _by_travel_type_sql(True))
def sentiment_by_travel_type_parity(spark, sf_dir):
    return dashboard.counts_by(
        _labelled(spark, sf_dir, True), "travel_type", "sentiment", name="review_count"
    )


@query(
    "sentiment_value_counts",
    f"""WITH {sql_cleaned(False)},
labelled AS (SELECT {_LABEL} AS sentiment FROM cleaned)
SELECT sentiment, count(*) AS n FROM labelled WHERE sentiment IS NOT NULL GROUP BY sentiment""",
)
def sentiment_value_counts(spark, sf_dir):
    return dashboard.value_counts(_labelled(spark, sf_dir, False), "sentiment")


_REGIONS = ["ASIA", "EUROPE"]
_SEGMENTS = ["BUILDING", "MACHINERY"]


def _customers(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))


@query(
    "cascading_filter_choices",
    f"""SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name IN {sql_in(_REGIONS)}""",
)
def cascading_filter_choices(spark, sf_dir):
    return dashboard.distinct_choices(_customers(spark, sf_dir), "n_name", {"r_name": _REGIONS})


@query(
    "cascading_filter_rows",
    f"""SELECT r_name, c_mktsegment, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN {sql_in(_REGIONS)} AND c_mktsegment IN {sql_in(_SEGMENTS)}
GROUP BY r_name, c_mktsegment""",
)
def cascading_filter_rows(spark, sf_dir):
    chosen = dashboard.filter_in(
        _customers(spark, sf_dir), {"r_name": _REGIONS, "n_name": [], "c_mktsegment": _SEGMENTS}
    )
    return dashboard.counts_by(chosen, "r_name", "c_mktsegment", name="customers")
