"""F10, F11, A9-A11, A14, A18, J3, J5, P7, P12, F18, F19."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import joined, query, sql_ascii_tokens, sql_in, sql_list, table
from reviewlake.functions.arrays import array_length, array_literal, compute_once, empty_to_null, item
from reviewlake.functions.text import ascii_tokens
from reviewlake.lexicons import CATEGORY_TERMS, DOMAIN_VOCABULARY, HOTEL_STOPWORDS, STOPWORDS, word_frame
from reviewlake.operators import tokens as ops
from reviewlake.operators.metrics import preview

# Words that occur in the stand-in texts, in three topics.
TOPICS = {
    "suffix": ["ing", "ble", "tion", "ment", "ung", "heit"],
    "pronoun": ["que", "elle", "ich", "sie", "los", "las"],
    "article": ["les", "une", "der", "die", "das", "una", "ing"],
}
VOCABULARY = sorted({w for words in TOPICS.values() for w in words})
SECOND_VOCABULARY = ["thatin", "rewh", "orre", "ononst", "sur", "mit", "para", "ther"]

_BANNED = [*STOPWORDS, *HOTEL_STOPWORDS]
_INFORMATIVE = f"length(token) >= 3 AND token NOT IN {sql_in(_BANNED)}"
_TOKENS = f"(SELECT doc_id, unnest({sql_ascii_tokens('text')}) AS token FROM documents)"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("tokens", ascii_tokens(F.col("text")))


@query("corpus_vocabulary", f"SELECT DISTINCT token FROM {_TOKENS} WHERE {_INFORMATIVE}")
def corpus_vocabulary(spark, sf_dir):
    return ops.corpus_vocabulary(_documents(spark, sf_dir), F.col("tokens"))


@query(
    "domain_tokens_of_corpus",
    f"SELECT DISTINCT token FROM {_TOKENS} WHERE {_INFORMATIVE} AND token IN {sql_in(VOCABULARY)}",
)
def domain_tokens_of_corpus(spark, sf_dir):
    return ops.domain_tokens_of_corpus(_documents(spark, sf_dir), F.col("tokens"), VOCABULARY)


@query(
    "token_count_distribution",
    f"""WITH c AS (SELECT doc_id, len({sql_ascii_tokens('text')}) AS every,
  len(list_filter({sql_ascii_tokens('text')},
    lambda w: length(w) >= 3 AND NOT list_contains({sql_list(_BANNED)}, w))) AS informative FROM documents),
s AS (SELECT 'tokens' AS side, every AS n FROM c UNION ALL SELECT 'informative', informative FROM c)
SELECT side, min(n)::INTEGER AS min_tokens, max(n)::INTEGER AS max_tokens,
  round(avg(n), 6) AS mean_tokens, median(n)::DOUBLE AS median_tokens FROM s GROUP BY side""",
)
def token_count_distribution(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        "tokens", ops.informative_tokens(F.col("tokens")).alias("informative")
    )
    stats = ops.size_distribution(docs, "tokens", "informative")
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


def _sides(spark, sf_dir):
    docs = compute_once(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), tokens=ascii_tokens(F.col("text"))
    )
    return compute_once(
        docs.select("doc_id", "lang", "tokens"),
        positive_tokens=ops.row_domain_tokens(F.col("tokens"), VOCABULARY),
        negative_tokens=ops.row_domain_tokens(F.col("tokens"), SECOND_VOCABULARY),
    ).drop("tokens")


def _sql_members(words) -> str:
    return f"list_sort(list_distinct(list_filter({sql_ascii_tokens('text')}, lambda w: list_contains({sql_list(words)}, w))))"


_SIDES = f"""sides AS (SELECT doc_id, lang, {_sql_members(VOCABULARY)} AS p,
  {_sql_members(SECOND_VOCABULARY)} AS n FROM documents)"""


@query(
    "row_domain_tokens",
    f"""WITH {_SIDES} SELECT doc_id, array_to_string(p, '|') AS positive_tokens,
  array_to_string(n, '|') AS negative_tokens FROM sides""",
)
def row_domain_tokens(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return sides.select(
        "doc_id", *[joined(c).alias(c) for c in ("positive_tokens", "negative_tokens")]
    )


@query(
    "domain_tokens_default",
    f"SELECT doc_id, array_to_string({_sql_members(DOMAIN_VOCABULARY)}, '|') AS tokens FROM documents",
)
def domain_tokens_default(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", joined(ops.row_domain_tokens(F.col("tokens"))).alias("tokens"))


@query(
    "domain_tokens_by_table",
    f"SELECT doc_id, array_to_string({_sql_members(VOCABULARY)}, '|') AS tokens FROM documents",
)
def domain_tokens_by_table(spark, sf_dir):
    docs = compute_once(
        table(spark, sf_dir, "documents").select("doc_id", "text"), tokens=ascii_tokens(F.col("text"))
    )
    found = ops.domain_tokens_by_table(
        docs.select("doc_id", "tokens"), "doc_id", "tokens", word_frame(spark, VOCABULARY), "found"
    )
    return found.select("doc_id", joined("found").alias("tokens"))


def _literal(c: str) -> str:
    return f"""CASE WHEN len({c}) > 0 THEN '{{' || array_to_string(
  list_transform({c}, lambda w: '"' || w || '"'), ',') || '}}' END"""


@query(
    "drop_without_tokens",
    f"""WITH {_SIDES} SELECT doc_id, {_literal('p')} AS positive_tokens, {_literal('n')} AS negative_tokens,
  CASE WHEN len(p) > 0 THEN len(p)::INTEGER END AS positive_length, p[1] AS first_positive
FROM sides WHERE len(p) > 0 OR len(n) > 0""",
)
def drop_without_tokens(spark, sf_dir):
    kept = ops.drop_without_tokens(_sides(spark, sf_dir), "positive_tokens", "negative_tokens")
    stored = kept.select(
        "doc_id", *[empty_to_null(F.col(c)).alias(c) for c in ("positive_tokens", "negative_tokens")]
    )
    return stored.select(
        "doc_id",
        array_literal(F.col("positive_tokens")).alias("positive_tokens"),
        array_literal(F.col("negative_tokens")).alias("negative_tokens"),
        array_length(F.col("positive_tokens")).alias("positive_length"),
        item(F.col("positive_tokens"), 1).alias("first_positive"),
    )


@query(
    "token_totals",
    f"""WITH {_SIDES} SELECT count(*) AS reviews, CAST(sum(len(p)) AS BIGINT) AS positive_tokens,
  CAST(sum(len(n)) AS BIGINT) AS negative_tokens, round(avg(len(p)), 6) AS positive_per_review,
  round(avg(len(n)), 6) AS negative_per_review, count(*) FILTER (len(p) = 0) AS empty_positive,
  count(*) FILTER (len(n) = 0) AS empty_negative,
  count(*) FILTER (len(p) = 0 AND len(n) = 0) AS empty_both,
  round(count(*) FILTER (len(p) > 0 OR len(n) > 0) / count(*) * 100, 6) AS retention_pct FROM sides""",
)
def token_totals(spark, sf_dir):
    totals = ops.token_totals(_sides(spark, sf_dir), "positive_tokens", "negative_tokens")
    rounded = ("positive_per_review", "negative_per_review", "retention_pct")
    return totals.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "preview_tokens",
    f"""WITH {_SIDES} SELECT doc_id, array_to_string(p, '|') AS positive_tokens,
  array_to_string(n, '|') AS negative_tokens FROM sides WHERE len(p) > 0 OR len(n) > 0
ORDER BY doc_id LIMIT 15""",
)
def preview_tokens(spark, sf_dir):
    sides = ("positive_tokens", "negative_tokens")
    first = preview(_sides(spark, sf_dir), 15, F.asc("doc_id"), non_empty=sides)
    return first.select("doc_id", *[joined(c).alias(c) for c in sides])


@query(
    "sentiment_slice",
    f"""WITH {_SIDES}, coded AS (SELECT *, CASE lang WHEN 'en' THEN -1 WHEN 'fr' THEN 0 ELSE 1 END AS code FROM sides)
SELECT doc_id, array_to_string(n, '|') AS tokens FROM coded WHERE code = -1 AND len(n) > 0""",
)
def sentiment_slice(spark, sf_dir):
    code = F.when(F.col("lang") == "en", -1).when(F.col("lang") == "fr", 0).otherwise(1)
    coded = _sides(spark, sf_dir).withColumn("code", code)
    kept = ops.sentiment_slice(coded, -1, "negative_tokens", "code")
    return kept.select("doc_id", joined("negative_tokens").alias("tokens"))


def _values(categories) -> str:
    first = {}
    for priority, (category, terms) in enumerate(categories.items()):
        for term in terms:
            first.setdefault(term, (category, priority))
    rows = ", ".join(f"('{t}', '{c}', {p})" for t, (c, p) in first.items())
    return f"(VALUES {rows}) AS v(token, category, priority)"


def _categories_sql(categories, tokens: str) -> str:
    return f"""WITH found AS (SELECT DISTINCT token, category, priority
  FROM {tokens} AS t JOIN {_values(categories)} USING (token))
SELECT category, priority, count(*) AS n_tokens,
  array_to_string(list_sort(list(token))[1:10], '|') AS first_tokens
FROM found GROUP BY category, priority"""


@query("token_categories", _categories_sql(TOPICS, _TOKENS))
def token_categories(spark, sf_dir):
    found = ops.token_categories(
        _documents(spark, sf_dir), F.col("tokens"), TOPICS, stopwords=(), domain_stopwords=(), min_length=1
    )
    return found.withColumn("first_tokens", joined("first_tokens"))


@query("token_categories_default", _categories_sql(CATEGORY_TERMS, _TOKENS))
def token_categories_default(spark, sf_dir):
    found = ops.token_categories(_documents(spark, sf_dir), F.col("tokens"))
    return found.withColumn("first_tokens", joined("first_tokens"))
