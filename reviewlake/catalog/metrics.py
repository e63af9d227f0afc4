"""A1, A7, A8, A16, A17, K8, S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import query, sql_ascii_tokens, sql_list, table
from reviewlake.catalog.tokens import SECOND_VOCABULARY, VOCABULARY
from reviewlake.functions.arrays import empty_to_null
from reviewlake.functions.text import ascii_tokens
from reviewlake.operators import metrics
from reviewlake.operators.tokens import row_domain_tokens


@query(
    "layer_counts",
    """SELECT 'bronze' AS layer, count(*) AS rows FROM pages UNION ALL
SELECT 'silver', count(*) FROM documents UNION ALL SELECT 'gold', count(*) FROM labels""",
)
def layer_counts(spark, sf_dir):
    return metrics.table_counts(
        bronze=table(spark, sf_dir, "pages"),
        silver=table(spark, sf_dir, "documents"),
        gold=table(spark, sf_dir, "labels"),
    )


@query(
    "layer_reconciliation",
    """WITH c AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) AS after,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS expected FROM events)
SELECT before, after, after - before AS inserted, expected, after - before = expected AS ok FROM c""",
)
def layer_reconciliation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return metrics.reconcile(
        events.where(F.col("ts") < cut), events, events.where(F.col("ts") >= cut)
    )


@query(
    "load_audit",
    """SELECT count(*) AS total_records, count(DISTINCT ts::DATE) AS distinct_load_dates,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_load, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_load
FROM events""",
)
def load_audit(spark, sf_dir):
    audit = metrics.load_audit(table(spark, sf_dir, "events"), "ts")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_load", "latest_load")}
    return audit.withColumns(text)


def _sql_audit(name: str, words) -> str:
    found = f"list_distinct(list_filter({sql_ascii_tokens('text')}, lambda w: list_contains({sql_list(words)}, w)))"
    return f"""SELECT '{name}' AS "column", count(*) AS stored, min(n)::INTEGER AS min_length,
  max(n)::INTEGER AS max_length FROM (SELECT len({found}) AS n FROM documents) WHERE n > 0"""


@query(
    "array_audit",
    _sql_audit("positive_tokens", VOCABULARY) + " UNION ALL " + _sql_audit("negative_tokens", SECOND_VOCABULARY),
)
def array_audit(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(ascii_tokens(F.col("text")).alias("t"))
    stored = tokens.select(
        empty_to_null(row_domain_tokens(F.col("t"), VOCABULARY)).alias("positive_tokens"),
        empty_to_null(row_domain_tokens(F.col("t"), SECOND_VOCABULARY)).alias("negative_tokens"),
    )
    return metrics.array_audit(stored, "positive_tokens", "negative_tokens")


@query(
    "translation_report",
    """WITH t AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT (SELECT count(*) FROM documents) AS source_rows, count(*) AS translated_rows,
  count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) AS with_translation,
  round(count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) / count(*) * 100, 6) AS coverage_pct,
  'SUCCESS' AS status FROM t""",
)
def translation_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    report = metrics.translation_report(docs, labelled, "quality", "toxic")
    return report.withColumn("coverage_pct", F.round("coverage_pct", 6))
