"""Query registry, table access and the SQL fragments shared by the checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.functions.text import WHITESPACE
from reviewlake.lexicons import CITIES, CONTRACTIONS, SENTIMENT_SENTINELS, SENTINELS_EXTENDED, STOPWORDS
from reviewlake.plans.cleaning import clean_columns
from reviewlake.session import persist_reliably
from reviewlake.sources.tables import spread_small_scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same question for DuckDB, if it can answer it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


#: Tables whose rows are texts, with the key that identifies a row.
_TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small_scan(df, *_TEXT_KEYS[name]) if name in _TEXT_KEYS else df


def joined(column, separator: str = "|"):
    """Lists are compared as text."""
    return F.array_join(column, separator)


# --- SQL fragments ----------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_in(values: Iterable[str]) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_strip(c: str) -> str:
    return f"trim({c}, {sql_text(WHITESPACE)})"


def sql_clean(c: str) -> str:
    letters = f"regexp_replace({c}, '[^a-zA-Z{WHITESPACE}]', ' ', 'g')"
    single = f"regexp_replace({letters}, '[{WHITESPACE}]{{2,}}', ' ', 'g')"
    return f"lower({sql_strip(single)})"


def sql_stop(c: str, stopwords: Iterable[str] = STOPWORDS) -> str:
    """Stop-word removal of an already cleaned text."""
    split_up = c
    for whole, parts in CONTRACTIONS.items():
        split_up = f"regexp_replace({split_up}, '\\b{whole}\\b', {sql_text(parts)}, 'g')"
    tokens = f"string_split_regex({sql_strip(split_up)}, '[{WHITESPACE}]+')"
    kept = f"list_filter({tokens}, lambda w: NOT list_contains({sql_list(stopwords)}, w))"
    return f"CASE WHEN {sql_strip(c)} = '' THEN {c} ELSE array_to_string({kept}, ' ') END"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_ascii_tokens(c: str) -> str:
    return f"list_filter({sql_words(c)}, lambda w: regexp_full_match(w, '[a-z]+'))"


def sql_vectorizer_tokens(c: str, stopwords: Iterable[str] = STOPWORDS) -> str:
    tokens = f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_filter({tokens}, lambda w: NOT list_contains({sql_list(stopwords)}, w))"


def sql_city(c: str) -> str:
    cases = " ".join(f"WHEN contains(lower({c}), {sql_text(n.lower())}) THEN {sql_text(n)}" for n in CITIES)
    return f"CASE {cases} END"


def sql_duration(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9a-zA-Z{WHITESPACE}]', ' ', 'g')"


def sql_sentiment(neg: str, pos: str, parity: bool) -> str:
    sentinels = sql_in(SENTIMENT_SENTINELS if parity else SENTINELS_EXTENDED)
    n = f"({neg} IS NOT NULL AND {neg} NOT IN {sentinels})"
    p = f"({pos} IS NOT NULL AND {pos} NOT IN {sentinels})"
    return f"CASE WHEN {n} AND {p} THEN -1 WHEN {n} THEN 0 WHEN {p} THEN 1 ELSE 2 END"


# --- the review-shaped view of the documents table --------------------------

_CITY_TEXTS = [
    "Hotels in Cairo", "LUXOR east bank", "aswan", "Sharm El Sheikh bay",
    "hurghada marina", "Alexandria or Cairo", "Giza", None,
]
_TRAVEL_TYPES = ["Couple", "Family", "Group", "Solo traveller", None]


def _side(text_when: tuple[int, ...], null_when: int, placeholder: str):
    i = F.col("doc_id")
    return (
        F.when((i % 4).isin(*text_when), F.col("text"))
        .when(i % 16 == null_when, F.lit(None))
        .when(i % 8 < 4, placeholder)
        .otherwise("Nothing")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped rows from every document."""
    i = F.col("doc_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        pick(_CITY_TEXTS).alias("city"),
        F.col("source").alias("hotel_name"),
        F.concat(F.lit("R"), (i % 97).cast("string")).alias("reviewer_name"),
        F.concat((i % 9 + 1).cast("string"), F.lit(" nights · ")).alias("duration"),
        pick(_TRAVEL_TYPES).alias("travel_type"),
        F.concat(F.lit("Reviewed: "), (i % 28 + 1).cast("string"), F.lit(" March 2024")).alias("review_date"),
        _side((0, 1), 15, "No Positive Feedback").alias("positive_review"),
        _side((0, 2, 3), 13, "No Negative Feedback").alias("negative_review"),
        "lang",
    )


def silver(spark: SparkSession, sf_dir: str, *columns: str, parity: bool = False) -> DataFrame:
    """Columns of the cleaned reviews as a stored layer.

    Reports read a stored layer on purpose: a filter on a computed column is moved
    below the projection, and every text would be cleaned once more for it.
    """
    return persist_reliably(clean_columns(reviews(spark, sf_dir), parity=parity).select(*columns))


def _sql_pick(values) -> str:
    cases = " ".join(
        f"WHEN {k} THEN {'NULL' if v is None else sql_text(v)}" for k, v in enumerate(values)
    )
    return f"CASE doc_id % {len(values)} {cases} END"


def _sql_side(text_when: tuple[int, ...], null_when: int, placeholder: str) -> str:
    return (
        f"CASE WHEN doc_id % 4 IN {text_when} THEN text WHEN doc_id % 16 = {null_when} THEN NULL "
        f"WHEN doc_id % 8 < 4 THEN {sql_text(placeholder)} ELSE 'Nothing' END"
    )


SQL_REVIEWS = f"""reviews AS (
SELECT doc_id AS id, {_sql_pick(_CITY_TEXTS)} AS city, source AS hotel_name,
  'R' || (doc_id % 97) AS reviewer_name, (1 + doc_id % 9) || ' nights · ' AS duration,
  {_sql_pick(_TRAVEL_TYPES)} AS travel_type,
  'Reviewed: ' || (1 + doc_id % 28) || ' March 2024' AS review_date,
  {_sql_side((0, 1), 15, "No Positive Feedback")} AS positive_review,
  {_sql_side((0, 2, 3), 13, "No Negative Feedback")} AS negative_review, lang
FROM documents)"""


def sql_cleaned(parity: bool) -> str:
    """CTEs ``reviews`` and ``cleaned`` (the cleaning job without dedup)."""
    raw = (lambda c: f"coalesce({c}, 'None')") if parity else (lambda c: c)
    empty = "'0'" if parity else "NULL"

    def side(c: str) -> str:
        return f"CASE WHEN {c} = '' THEN {empty} ELSE {c} END AS {c}"

    return f"""{SQL_REVIEWS},
lettered AS MATERIALIZED (SELECT * REPLACE ({sql_clean(raw('hotel_name'))} AS hotel_name,
  {sql_clean(raw('positive_review'))} AS positive_review,
  {sql_clean(raw('negative_review'))} AS negative_review,
  {sql_city('city')} AS city, {sql_duration(raw('duration'))} AS duration,
  replace({raw('review_date')}, 'Reviewed: ', '') AS review_date) FROM reviews),
stopped AS MATERIALIZED (SELECT * REPLACE ({sql_stop('hotel_name')} AS hotel_name,
  {sql_stop('positive_review')} AS positive_review,
  {sql_stop('negative_review')} AS negative_review) FROM lettered),
marked AS (SELECT * REPLACE ({side('positive_review')}, {side('negative_review')}) FROM stopped),
cleaned AS MATERIALIZED (SELECT *, {sql_sentiment('negative_review', 'positive_review', parity)}
  AS sentiment_classification FROM marked)"""


# --- TF-IDF in SQL ----------------------------------------------------------


def sql_tfidf(prefix: str, source: str, stopwords: Iterable[str] = STOPWORDS, features: int = 1000) -> str:
    """CTEs ending in ``<prefix>_vocab`` and ``<prefix>_top`` (id, rank, term).

    ``source`` is a relation (id, text).
    """
    p = prefix
    return f"""{p}_tok AS MATERIALIZED (SELECT id, {sql_vectorizer_tokens('text', stopwords)} AS l
  FROM {source} WHERE length({sql_strip('text')}) > 10),
{p}_n AS (SELECT count(*) AS n FROM {p}_tok),
{p}_terms AS (SELECT id, unnest(l) AS term FROM {p}_tok UNION ALL
  SELECT id, unnest(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1]))
  FROM {p}_tok WHERE len(l) > 1),
{p}_tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM {p}_terms GROUP BY id, term),
{p}_df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM {p}_tf GROUP BY term),
{p}_vocab AS (SELECT term, total, df, ln((1 + n)::DOUBLE / (1 + df)) + 1.0 AS idf FROM {p}_df, {p}_n
  WHERE n > 1 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT {features}),
{p}_top AS (SELECT id, term, rank FROM (
  SELECT id, t.term, row_number() OVER (PARTITION BY id ORDER BY tf * idf DESC, t.term DESC) AS rank
  FROM {p}_tf t JOIN {p}_vocab v ON t.term = v.term) WHERE rank <= 3)"""
