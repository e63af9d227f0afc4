"""J1, K6, K7, K8, the gold job (E3) and the whole bronze -> gold run."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from reviewlake.catalog.language import PROFILES_SQL, SHORTCUT_SQL, sql_detect
from reviewlake.catalog.registry import (
    joined,
    query,
    reviews,
    silver,
    sql_ascii_tokens,
    sql_cleaned,
    sql_in,
    sql_list,
    sql_strip,
    sql_tfidf,
    table,
)
from reviewlake.lexicons import HOTEL_STOPWORDS, NO_TRANSLATION_NEGATIVE, NO_TRANSLATION_POSITIVE, STOPWORDS
from reviewlake.operators.dedup import duplicate_count, new_rows
from reviewlake.operators.metrics import side_by_side
from reviewlake.operators.translate import apply_memory
from reviewlake.operators.language import fit_language_profiles
from reviewlake.plans.cleaning import clean_columns
from reviewlake.plans.gold import build_gold
from reviewlake.plans.layers import Layers, run_layers
from reviewlake.schemas import BRONZE_REVIEWS, conform
from reviewlake.session import ensure_checkpoint_dir, persist_reliably, scratch_path
from reviewlake.sources.sinks import append_new_bucketed, create_bucketed

_KEYS = ["o_custkey", "status", "o_orderpriority"]
_ORDERS = """orders_n AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority,
  o_totalprice, o_orderdate FROM orders),
target AS (SELECT * FROM orders_n WHERE o_orderdate < TIMESTAMP '1998-01-01'),
batch AS (SELECT o_orderkey, o_custkey, status, o_orderpriority, o_totalprice
  FROM orders_n WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""


def _orders(spark, sf_dir):
    """Stored rows and a batch: the orders before and after one date."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        "o_orderpriority",
        "o_totalprice",
        "o_orderdate",
    )
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.where(F.col("o_orderdate") < cut), orders.where(
        F.col("o_orderdate") >= cut
    ).drop("o_orderdate")


def _exists(equal: str) -> str:
    return " AND ".join(f"t.{k} {equal} b.{k}" for k in _KEYS)


_NULL_KEY = " OR ".join(f"b.{k} IS NULL" for k in _KEYS)


@query(
    "gold_append_new",
    f"""WITH {_ORDERS},
first AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY o_orderkey) AS r FROM batch)
SELECT o_orderkey, o_custkey, status, o_orderpriority, o_totalprice FROM first b
WHERE ({_NULL_KEY}) OR (r = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE {_exists('=')}))""",
)
def gold_append_new(spark, sf_dir):
    target, batch = _orders(spark, sf_dir)
    return new_rows(batch, target, _KEYS, order="o_orderkey", null_safe=False)


@query(
    "gold_append_new_nullsafe",
    f"""WITH {_ORDERS},
first AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY o_orderkey) AS r FROM batch)
SELECT o_orderkey, o_custkey, status, o_orderpriority, o_totalprice FROM first b
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE {_exists('IS NOT DISTINCT FROM')})""",
)
def gold_append_new_nullsafe(spark, sf_dir):
    target, batch = _orders(spark, sf_dir)
    return new_rows(batch, target, _KEYS, order="o_orderkey", null_safe=True)


@query(
    "gold_append_bucketed",
    f"""WITH {_ORDERS},
first AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY o_orderkey) AS r FROM batch)
SELECT o_orderkey, o_custkey, status, o_orderpriority, o_totalprice FROM first b
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE {_exists('IS NOT DISTINCT FROM')})""",
)
def gold_append_bucketed(spark, sf_dir):
    """Appended twice to a table in buckets, which is not shuffled; the second time adds none."""
    target, batch = _orders(spark, sf_dir)
    name = f"gold_{uuid4().hex}"
    create_bucketed(spark, name, batch.schema, _KEYS, 16, scratch_path(spark, "bucketed"))
    append_new_bucketed(target.select(*batch.columns), name, _KEYS, "o_orderkey")
    added = append_new_bucketed(batch, name, _KEYS, "o_orderkey")
    return added.unionByName(append_new_bucketed(batch, name, _KEYS, "o_orderkey"))


@query(
    "gold_duplicate_count",
    f"""WITH {_ORDERS},
n AS (SELECT count(*) AS total, count(*) FILTER (
  NOT EXISTS (SELECT 1 FROM target t WHERE {_exists('=')})) AS new FROM batch b)
SELECT total, new, total - new AS duplicates FROM n""",
)
def gold_duplicate_count(spark, sf_dir):
    target, batch = _orders(spark, sf_dir)
    return duplicate_count(batch, target, _KEYS)


# --- the gold job -----------------------------------------------------------

# Words that come up as key phrases of the stand-in texts.
GOLD_VOCABULARY = """
ing ble tion ther thth thon thhe thha thre thnt thed thin thor rewh orre thatin
ononst inoran hehely orantion que les des une aux ment der die und ich lich ung
los las del ción ado ere hat ent ion ati
""".split()

_GOLD_TOKENS = sorted(
    {w for w in GOLD_VOCABULARY if len(w) >= 3} - set(STOPWORDS) - set(HOTEL_STOPWORDS)
)


_SILVER_COLUMNS = [
    "id", "city", "hotel_name", "reviewer_name", "duration", "travel_type", "review_date",
    "positive_review", "negative_review", "lang", "sentiment_classification",
]


def _translated(spark, sf_dir):
    """Cleaned reviews with both sides translated through a stand-in memory."""
    cleaned = silver(spark, sf_dir, *_SILVER_COLUMNS)
    labelled = cleaned.join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi"
    )
    texts = F.explode(F.array("positive_review", "negative_review")).alias("text")
    memory = (
        labelled.where(F.col("lang") != "en")
        .select("lang", texts)
        .where(F.col("text").isNotNull())
        .distinct()
        .withColumn("translated", F.concat(F.lit("translated "), "text"))
    )
    for side, sentinels in (
        ("negative_review", NO_TRANSLATION_NEGATIVE),
        ("positive_review", NO_TRANSLATION_POSITIVE),
    ):
        cleaned = apply_memory(cleaned, "id", side, "lang", memory, sentinels, f"{side}_translated")
    return persist_reliably(cleaned)


def _sql_translated(side: str, sentinels) -> str:
    return f"""CASE WHEN c.lang <> 'en' AND length({sql_strip(f'c.{side}')}) > 3
  AND c.{side} NOT IN {sql_in(sentinels)} THEN coalesce(
  (SELECT any_value(translated) FROM memory m WHERE m.lang = c.lang AND m.text = c.{side}), c.{side})
  ELSE c.{side} END"""


def _sql_tokens(side: str) -> str:
    phrase_tokens = sql_ascii_tokens("string_agg(term, ' ')")
    keep = f"list_filter({phrase_tokens}, lambda w: list_contains({sql_list(_GOLD_TOKENS)}, w))"
    return f"{side}_tokens AS (SELECT id, list_sort(list_distinct({keep})) AS l FROM {side}_top GROUP BY id)"


@query(
    "reviews_gold",
    f"""WITH {sql_cleaned(False)},
labelled AS (SELECT c.* FROM cleaned c JOIN labels l ON l.doc_id = c.id),
memory AS (SELECT DISTINCT lang, text, 'translated ' || text AS translated FROM (
  SELECT lang, positive_review AS text FROM labelled UNION ALL SELECT lang, negative_review FROM labelled)
  WHERE lang <> 'en' AND text IS NOT NULL),
silver AS (SELECT c.*, coalesce({_sql_translated('positive_review', NO_TRANSLATION_POSITIVE)}, '') AS pos,
  coalesce({_sql_translated('negative_review', NO_TRANSLATION_NEGATIVE)}, '') AS neg FROM cleaned c),
pos_src AS (SELECT id, pos AS text FROM silver), neg_src AS (SELECT id, neg AS text FROM silver),
{sql_tfidf('p', 'pos_src')},
{sql_tfidf('n', 'neg_src')},
{_sql_tokens('p')},
{_sql_tokens('n')},
sides AS (SELECT s.*, coalesce(p.l, []) AS pl, coalesce(n.l, []) AS nl
  FROM silver s LEFT JOIN p_tokens p ON p.id = s.id LEFT JOIN n_tokens n ON n.id = s.id)
SELECT id, city, hotel_name, reviewer_name, duration, review_date, travel_type, pos AS positive_review,
  neg AS negative_review, sentiment_classification,
  CASE WHEN len(pl) > 0 THEN array_to_string(pl, '|') END AS positive_tokens,
  CASE WHEN len(nl) > 0 THEN array_to_string(nl, '|') END AS negative_tokens
FROM sides WHERE len(pl) > 0 OR len(nl) > 0""",
)
def reviews_gold(spark, sf_dir):
    gold = build_gold(_translated(spark, sf_dir), GOLD_VOCABULARY)
    return gold.withColumns({c: joined(c) for c in ("positive_tokens", "negative_tokens")})


# --- the whole run ----------------------------------------------------------

_COPY = 10_000_000


def _bronze(spark, sf_dir):
    """Reviews from every document; a tenth of them was collected twice."""
    once = reviews(spark, sf_dir).drop("lang")
    again = once.where(F.col("id") % 10 == 3).withColumn("id", F.col("id") + _COPY)
    return conform(once.unionByName(again), BRONZE_REVIEWS)


def _known_translations(spark, sf_dir):
    """A stand-in memory: the cleaned texts of the labelled foreign reviews."""
    labelled = reviews(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi"
    )
    cleaned = clean_columns(labelled.where(F.col("lang") != "en"))
    texts = cleaned.select("lang", F.explode(F.array("positive_review", "negative_review")).alias("text"))
    return texts.where(F.col("text").isNotNull()).distinct().withColumn(
        "translated", F.concat(F.lit("translated "), "text")
    )


def _sql_side(side: str, lang: str, sentinels) -> str:
    return f"""coalesce(CASE WHEN {lang} <> 'en' AND length({sql_strip(f'k.{side}')}) > 3
  AND k.{side} NOT IN {sql_in(sentinels)} THEN coalesce(
  (SELECT any_value(translated) FROM memory m WHERE m.lang = {lang} AND m.text = k.{side}), k.{side})
  ELSE k.{side} END, '')"""


_SQL_MEMORY = """labelled AS (SELECT c.* FROM cleaned c JOIN labels l ON l.doc_id = c.id),
memory AS MATERIALIZED (SELECT DISTINCT lang, text, 'translated ' || text AS translated FROM (
  SELECT lang, positive_review AS text FROM labelled UNION ALL SELECT lang, negative_review FROM labelled)
  WHERE lang <> 'en' AND text IS NOT NULL),
"""


def _sql_run(memory: str, side) -> str:
    """The stages of the run as common tables, ending in ``sides`` and ``fresh``."""
    return f"""WITH {sql_cleaned(False)},
bronze AS (SELECT * EXCLUDE (lang) FROM reviews UNION ALL
  SELECT * EXCLUDE (lang) REPLACE (id + {_COPY} AS id) FROM reviews WHERE id % 10 = 3),
uniq AS (SELECT min(id) AS id FROM bronze GROUP BY city, hotel_name, reviewer_name, duration, travel_type,
  review_date, positive_review, negative_review),
{PROFILES_SQL},
src AS (SELECT 'p:' || id AS id, positive_review AS text FROM reviews
  UNION ALL SELECT 'n:' || id, negative_review FROM reviews),
hits AS (SELECT id, coalesce({SHORTCUT_SQL}, TRUE) AS english FROM src),
{sql_detect('src')},
tagged AS MATERIALIZED (SELECT hits.id, CASE WHEN english THEN 'en' ELSE detected.lang END AS lang
  FROM hits JOIN detected ON detected.id = hits.id),
{memory}k AS (SELECT c.*, p.lang AS pos_lang, n.lang AS neg_lang FROM cleaned c JOIN uniq ON uniq.id = c.id
  JOIN tagged p ON p.id = 'p:' || c.id JOIN tagged n ON n.id = 'n:' || c.id),
silver AS MATERIALIZED (SELECT k.*, {side('positive_review', 'k.pos_lang', NO_TRANSLATION_POSITIVE)} AS pos,
  {side('negative_review', 'k.neg_lang', NO_TRANSLATION_NEGATIVE)} AS neg FROM k),
pos_src AS (SELECT id, pos AS text FROM silver), neg_src AS (SELECT id, neg AS text FROM silver),
{sql_tfidf('p', 'pos_src')},
{sql_tfidf('n', 'neg_src')},
{_sql_tokens('p')},
{_sql_tokens('n')},
sides AS (SELECT s.*, coalesce(p.l, []) AS pl, coalesce(n.l, []) AS nl
  FROM silver s LEFT JOIN p_tokens p ON p.id = s.id LEFT JOIN n_tokens n ON n.id = s.id),
fresh AS (SELECT *, row_number() OVER (PARTITION BY city, hotel_name, reviewer_name, review_date ORDER BY id) AS r
  FROM sides WHERE len(pl) > 0 OR len(nl) > 0)"""


@query(
    "reviews_pipeline_gold",
    f"""{_sql_run(_SQL_MEMORY, _sql_side)}
SELECT city, hotel_name, reviewer_name, duration, review_date, travel_type, pos AS positive_review,
  neg AS negative_review, sentiment_classification,
  CASE WHEN len(pl) > 0 THEN array_to_string(pl, '|') END AS positive_tokens,
  CASE WHEN len(nl) > 0 THEN array_to_string(nl, '|') END AS negative_tokens, TRUE AS stamped
FROM fresh WHERE r = 1""",
)
def reviews_pipeline_gold(spark, sf_dir):
    """Every stage through ``run_layers`` in a new folder: dedup, languages, cleaning, memory,
    phrases, tokens, append."""
    layers = Layers(f"{ensure_checkpoint_dir(spark)}/layers-{uuid4().hex}")
    _known_translations(spark, sf_dir).write.parquet(layers.memory)
    profiles = fit_language_profiles(table(spark, sf_dir, "documents"), "text", "lang")
    run_layers(spark, persist_reliably(_bronze(spark, sf_dir)), layers, profiles, vocabulary=GOLD_VOCABULARY)
    stored = spark.read.parquet(layers.gold)
    stamped = F.col("id").isNotNull() & F.col("inserted_at").isNotNull()
    return stored.select(
        "city", "hotel_name", "reviewer_name", "duration", "review_date", "travel_type", "positive_review",
        "negative_review", "sentiment_classification", joined("positive_tokens").alias("positive_tokens"),
        joined("negative_tokens").alias("negative_tokens"), stamped.alias("stamped"),
    )


def _sql_translated_side(side: str, lang: str, sentinels) -> str:
    return f"""coalesce(CASE WHEN {lang} <> 'en' AND length({sql_strip(f'k.{side}')}) > 3
  AND k.{side} NOT IN {sql_in(sentinels)} AND length(k.{side}) % 7 <> 0 THEN 'translated ' || k.{side} ELSE k.{side} END, '')"""


def _stand_in_translator(texts: list[str], langs: list[str]) -> list[str | None]:
    """Translates by a mark, and fails on one length of texts in seven."""
    return [None if len(t) % 7 == 0 else f"translated {t}" for t in texts]


@query(
    "translator_run_reports",
    f"""{_sql_run('', _sql_translated_side)},
n AS (SELECT count(*) AS silver_rows, count(*) FILTER (positive_review IS NOT NULL OR negative_review IS NOT NULL) AS w FROM silver),
g AS (SELECT count(*) AS final_rows, coalesce(sum(len(pl)), 0)::BIGINT AS positive_tokens,
  coalesce(sum(len(nl)), 0)::BIGINT AS negative_tokens FROM sides WHERE len(pl) > 0 OR len(nl) > 0)
SELECT silver_rows AS source_rows, final_rows, (SELECT count(*) FROM fresh WHERE r = 1) AS ingested_rows, positive_tokens,
  negative_tokens, CASE WHEN (SELECT count(*) FROM fresh WHERE r = 1) > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  silver_rows AS translated_rows, w AS with_translation, round(w / silver_rows * 100, 6) AS coverage_pct FROM n, g""",
)
def translator_run_reports(spark, sf_dir):
    """The whole run with a translator in place of a known memory; its gold and translation reports."""
    layers = Layers(scratch_path(spark, "layers"))
    profiles = fit_language_profiles(table(spark, sf_dir, "documents"), "text", "lang")
    bronze = persist_reliably(_bronze(spark, sf_dir))
    reports = run_layers(spark, bronze, layers, profiles, _stand_in_translator, vocabulary=GOLD_VOCABULARY)
    coverage = F.round("coverage_pct", 6).alias("coverage_pct")
    return side_by_side(reports["gold"], reports["translation"].select("translated_rows", "with_translation", coverage))
