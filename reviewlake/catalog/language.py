"""F12, F13, F17, P8, P13, J4, A15."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import query, sql_in, sql_strip, sql_text, table
from reviewlake.lexicons import ENGLISH_PATTERNS, NO_TRANSLATION_NEGATIVE
from reviewlake.operators import language, translate

_LOW = f"lower({sql_strip('text')})"
_HITS = " + ".join(f"contains({_LOW}, {sql_text(p)})::INTEGER" for p in ENGLISH_PATTERNS)


#: Whether a column ``text`` needs no detector; NULL for a NULL text.
SHORTCUT_SQL = f"(length({sql_strip('text')}) < 4 OR ({_HITS}) >= 2)"


@query(
    "english_shortcut",
    f"""WITH h AS (SELECT doc_id, text, {_HITS} AS hits FROM documents)
SELECT doc_id, hits, length({sql_strip('text')}) < 4 OR hits >= 2 AS is_english FROM h""",
)
def english_shortcut(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        language.pattern_hits(text).alias("hits"),
        language.english_shortcut(text).alias("is_english"),
    )


def _sql_trigrams(key: str, source: str, extra: str = "") -> str:
    return f"""(SELECT {key}{extra}, unnest(list_transform(generate_series(1, length(w)),
  lambda i: substring(' ' || w || ' ', i, 3))) AS trigram
  FROM (SELECT {key}{extra}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM {source}))"""


PROFILES_SQL = f"""counts AS (SELECT lang, trigram, count(*) AS n FROM {_sql_trigrams('lang', 'documents')}
  WHERE lang IS NOT NULL GROUP BY lang, trigram),
floors AS (SELECT lang, round(-ln((sum(n) + (SELECT count(DISTINCT trigram) FROM counts))::DOUBLE) * 1000000)::BIGINT
  AS floor FROM counts GROUP BY lang),
profiles AS (SELECT lang, trigram, round(ln((n + 1)::DOUBLE) * 1000000)::BIGINT AS gain, floor
  FROM counts JOIN floors USING (lang))"""


def sql_detect(source: str) -> str:
    """CTE ``detected`` (id, lang) for a relation (id, text)."""
    return f"""grams AS (SELECT id, trigram FROM {_sql_trigrams('id', source)}
  WHERE id IN (SELECT id FROM {source} WHERE length({sql_strip('text')}) > 3)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
scores AS (SELECT g.id, p.lang, CAST(sum(gain) AS BIGINT) + max(s.n) * max(floor) AS score
  FROM grams g JOIN profiles p USING (trigram) JOIN sizes s ON s.id = g.id GROUP BY g.id, p.lang),
best AS (SELECT id, lang FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r
  FROM scores) WHERE r = 1),
detected AS (SELECT x.id, coalesce(best.lang, 'en') AS lang FROM {source} x LEFT JOIN best ON best.id = x.id)"""


def _profiles(spark, sf_dir):
    return language.fit_language_profiles(table(spark, sf_dir, "documents"), "text", "lang")


@query(
    "language_profiles",
    f"WITH {PROFILES_SQL} SELECT lang, trigram, gain, floor FROM profiles",
)
def language_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query(
    "language_id_trigram",
    f"""WITH {PROFILES_SQL}, turns AS (SELECT conv_id || ':' || turn AS id, text FROM conversations),
{sql_detect('turns')} SELECT id, lang FROM detected""",
)
def language_id_trigram(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text"
    )
    return language.detect_language(turns, "id", "text", _profiles(spark, sf_dir))


@query(
    "language_id_accuracy",
    f"""WITH {PROFILES_SQL}, docs AS (SELECT doc_id AS id, text FROM documents), {sql_detect('docs')}
SELECT d.lang AS labelled, t.lang AS detected, count(*) AS n
FROM documents d JOIN detected t ON d.doc_id = t.id GROUP BY d.lang, t.lang""",
)
def language_id_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.detect_language(docs, "doc_id", "text", _profiles(spark, sf_dir))
    paired = docs.select("doc_id", F.col("lang").alias("labelled")).join(
        found.select("doc_id", F.col("lang").alias("detected")), "doc_id"
    )
    return paired.groupBy("labelled", "detected").agg(F.count("*").alias("n"))


@query(
    "language_tag",
    f"""WITH {PROFILES_SQL}, turns AS (SELECT conv_id || ':' || turn AS id, text FROM conversations),
hits AS (SELECT id, length({sql_strip('text')}) < 4 OR ({_HITS}) >= 2 AS english FROM turns),
{sql_detect('turns')}
SELECT hits.id, CASE WHEN english THEN 'en' ELSE lang END AS lang FROM hits JOIN detected USING (id)""",
)
def language_tag(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text"
    )
    return language.tag_language(turns, "id", "text", _profiles(spark, sf_dir)).select("id", "lang")


_WANTED = f"""(lang <> 'en' AND length({sql_strip('text')}) > 3
  AND lower({sql_strip('text')}) NOT IN {sql_in(NO_TRANSLATION_NEGATIVE)})"""
_MEMORY = """memory AS (SELECT DISTINCT lang, text, '[' || lang || '>en] ' || text AS translated
  FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en')"""


def _memory(spark, sf_dir):
    """Stand-in memory: the labelled foreign texts, each with a made-up translation."""
    labelled = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    marked = F.concat(F.lit("["), "lang", F.lit(">en] "), "text").alias("translated")
    return labelled.where(F.col("lang") != "en").select("lang", "text", marked).distinct()


@query("translation_candidates", f"SELECT DISTINCT lang, text FROM documents WHERE {_WANTED}")
def translation_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return translate.translation_candidates(docs, "text", "lang", NO_TRANSLATION_NEGATIVE)


@query(
    "translation_misses",
    f"""WITH {_MEMORY} SELECT DISTINCT lang, text FROM documents d WHERE {_WANTED}
AND NOT EXISTS (SELECT 1 FROM memory m WHERE m.lang = d.lang AND m.text = d.text)""",
)
def translation_misses(spark, sf_dir):
    wanted = translation_candidates(spark, sf_dir)
    return translate.memory_misses(wanted, _memory(spark, sf_dir))


_JOINED = f"""joined AS (SELECT doc_id, d.lang,
  CASE WHEN {_WANTED.replace('text', 'd.text').replace('lang', 'd.lang')}
  THEN coalesce(translated, d.text) ELSE d.text END AS translated
FROM documents d LEFT JOIN memory m ON m.lang = d.lang AND m.text = d.text)"""


@query(
    "translation_memory_join",
    f"WITH {_MEMORY}, {_JOINED} SELECT doc_id, lang, translated FROM joined",
)
def translation_memory_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = translate.apply_memory(
        docs, "doc_id", "text", "lang", _memory(spark, sf_dir), NO_TRANSLATION_NEGATIVE, "translated"
    )
    return out.select("doc_id", "lang", "translated")


@query(
    "translation_memory_hit_rate",
    """SELECT count(*) AS lookups, count(DISTINCT (lang, text)) AS misses,
  count(*) - count(DISTINCT (lang, text)) AS hits,
  round((count(*) - count(DISTINCT (lang, text))) / count(*) * 100, 6) AS hit_rate FROM documents""",
)
def translation_memory_hit_rate(spark, sf_dir):
    stats = translate.memory_hit_rate(table(spark, sf_dir, "documents"), "lang", "text")
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "translation_coverage",
    """SELECT count(*) AS rows, count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) AS with_translation,
  round(count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) / count(*) * 100, 6) AS coverage_pct
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def translation_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    stats = translate.translation_coverage(
        docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "toxic"
    )
    return stats.withColumn("coverage_pct", F.round("coverage_pct", 6))
