"""F14-F16, A13, P9, T2."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import (
    joined,
    query,
    sql_strip,
    sql_tfidf,
    sql_vectorizer_tokens,
    table,
)
from reviewlake.operators import phrases as ops, word_vectors
from reviewlake.session import persist_reliably

_SOURCE = "docs AS (SELECT doc_id AS id, text FROM documents)"


@query(
    "tfidf_vocabulary",
    f"""WITH {_SOURCE}, {sql_tfidf('d', 'docs')}
SELECT term, total, df, round(idf, 6) AS idf FROM d_vocab""",
)
def tfidf_vocabulary(spark, sf_dir):
    vocabulary = ops.fit_vocabulary(table(spark, sf_dir, "documents"), "text")
    return vocabulary.withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_vocabulary_large",
    f"""WITH {_SOURCE}, {sql_tfidf('d', 'docs', features=60_000)}
SELECT term, total, df, round(idf, 6) AS idf FROM d_vocab""",
)
def tfidf_vocabulary_large(spark, sf_dir):
    """a vocabulary that stays a table."""
    vocabulary = ops.fit_vocabulary(table(spark, sf_dir, "documents"), "text", max_features=60_000)
    return vocabulary.withColumn("idf", F.round("idf", 6))


@query(
    "term_scores_large",
    f"""WITH {_SOURCE}, {sql_tfidf('d', 'docs', features=60_000)}
SELECT id AS doc_id, count(*) AS terms, sum(tf)::BIGINT AS tf, round(sum(tf * idf), 4) AS score
FROM d_tf t JOIN d_vocab v ON t.term = v.term GROUP BY id""",
)
def term_scores_large(spark, sf_dir):
    """The scores of a vocabulary that stays a table, added up per text."""
    docs = table(spark, sf_dir, "documents")
    scores = ops.term_scores(docs, "doc_id", "text", ops.fit_vocabulary(docs, "text", max_features=60_000))
    totals = scores.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"), F.sum("score").alias("score"))
    return totals.withColumn("score", F.round("score", 4))


@query(
    "tfidf_top_phrases",
    f"""WITH {_SOURCE}, {sql_tfidf('d', 'docs')},
lists AS (SELECT id, string_agg(term, '|' ORDER BY rank) AS phrases FROM d_top GROUP BY id)
SELECT docs.id AS doc_id, coalesce(phrases, '') AS phrases FROM docs LEFT JOIN lists ON docs.id = lists.id""",
)
def tfidf_top_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = ops.key_phrases(docs, "doc_id", "text")
    return ops.attach_phrases(docs.select("doc_id"), "doc_id", found, "phrases").withColumn(
        "phrases", joined("phrases")
    )


@query(
    "term_scores",
    f"""WITH {_SOURCE}, {sql_tfidf('d', 'docs')}
SELECT id AS doc_id, t.term, tf, round(tf * idf, 6) AS score FROM d_tf t JOIN d_vocab v ON t.term = v.term""",
)
def term_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vocabulary = ops.fit_vocabulary(docs, "text")
    scores = ops.term_scores(docs, "doc_id", "text", vocabulary)
    return scores.withColumn("score", F.round("score", 6))


def _sql_cells(source: str, key: str, text: str, name: str) -> str:
    """Cell counts and their norm of each text: the default encoder in SQL."""
    chars = f"string_split(' ' || {text} || ' ', '')"
    code = "(unicode(c[i]) * 1000003 + unicode(c[i + 1]) * 8191 + unicode(c[i + 2]) * 131) % 256"
    return f"""{name} AS MATERIALIZED (SELECT {key}, cell, count(*) AS n FROM (
  SELECT {key}, unnest(list_transform(generate_series(1, len(c) - 2), lambda i: {code})) AS cell
  FROM (SELECT {key}, {chars} AS c FROM {source})) GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(n * n)::DOUBLE) AS norm FROM {name} GROUP BY {key})"""


_EMBEDDING_SQL = f"""WITH tok AS MATERIALIZED (SELECT doc_id, lower(text) AS t, {sql_vectorizer_tokens('text')} AS l
  FROM documents WHERE length({sql_strip('text')}) > 10),
cand AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(l) AS term FROM tok UNION ALL
  SELECT doc_id, unnest(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1]))
  FROM tok WHERE len(l) > 1)),
terms AS (SELECT DISTINCT term FROM cand),
{_sql_cells('tok', 'doc_id', 't', 'd')},
{_sql_cells('terms', 'term', 'term', 'p')},
dots AS (SELECT c.doc_id, c.term, sum(p.n * d.n)::DOUBLE AS dot
  FROM cand c JOIN p ON p.term = c.term JOIN d ON d.doc_id = c.doc_id AND d.cell = p.cell GROUP BY ALL),
scored AS (SELECT doc_id, x.term, round(dot / (p_norm.norm * d_norm.norm), 9) AS score
  FROM dots x JOIN p_norm ON p_norm.term = x.term JOIN d_norm USING (doc_id)),
best AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term DESC) AS rank
  FROM scored WHERE score > 0),
lists AS (SELECT doc_id, string_agg(term, '|' ORDER BY rank) AS phrases FROM best WHERE rank <= 3 GROUP BY doc_id)
SELECT doc_id, coalesce(phrases, '') AS phrases FROM documents LEFT JOIN lists USING (doc_id)"""


@query("embedding_top_phrases", _EMBEDDING_SQL)
def embedding_top_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = ops.key_phrases(docs, "doc_id", "text", method="embedding")
    return ops.attach_phrases(docs.select("doc_id"), "doc_id", found, "phrases").withColumn(
        "phrases", joined("phrases")
    )


@query(
    "vector_topk_cosine",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine
FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10""",
)
def vector_topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id"))
    nearest = ops.cosine_top_k(vectors, "vec_id", "embedding", first, 10)
    return nearest.withColumn("cosine", F.round("cosine", 6))


@query(
    "word_associations",
    f"""WITH tok AS MATERIALIZED (SELECT {sql_vectorizer_tokens('text')} AS l FROM documents WHERE length({sql_strip('text')}) > 10),
listed AS (SELECT t FROM (SELECT unnest(l) AS t FROM tok) GROUP BY t ORDER BY count(*) DESC, t LIMIT 500),
near AS (SELECT unnest(list_transform(generate_series(1, len(l) - d), lambda i: {{'x': l[i], 'y': l[i + d]}})) AS p
  FROM tok, generate_series(1, 4) AS g(d) WHERE len(l) > d),
pairs AS MATERIALIZED (SELECT least(p.x, p.y) AS a, greatest(p.x, p.y) AS b, count(*) AS n FROM near
  WHERE p.x IN (SELECT t FROM listed) AND p.y IN (SELECT t FROM listed) GROUP BY ALL),
margins AS MATERIALIZED (SELECT t, sum(n)::DOUBLE AS m FROM (SELECT a AS t, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY t),
told AS (SELECT a, b, n, ln(((CASE WHEN a = b THEN 2 ELSE 1 END) * n)::DOUBLE * (SELECT sum(m) FROM margins) / (x.m * y.m)) AS ppmi
  FROM pairs JOIN margins x ON x.t = a JOIN margins y ON y.t = b)
SELECT a, b, n, round(ppmi, 6) AS ppmi FROM told WHERE ppmi > 0""",
)
def word_associations(spark, sf_dir):
    """what the trained encoder learns from: words that stand near each other."""
    docs = table(spark, sf_dir, "documents")
    tokens = word_vectors.token_lists(docs, "text")
    pairs = word_vectors.cooccurrences(tokens, word_vectors.frequent_words(tokens, 500))
    return word_vectors.positive_information(persist_reliably(pairs)).withColumn("ppmi", F.round("ppmi", 6))


@query("trained_top_phrases")
def trained_top_phrases(spark, sf_dir):
    """F15 with an encoder learnt from the same texts; no SQL, since it holds eigenvectors."""
    docs = table(spark, sf_dir, "documents")
    encoder = word_vectors.fit_word_vectors(docs, "text")
    found = ops.key_phrases(docs, "doc_id", "text", method="embedding", encoder=encoder)
    return ops.attach_phrases(docs.select("doc_id"), "doc_id", found, "phrases").withColumn(
        "phrases", joined("phrases")
    )
