"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.llm import (
    chat_format, containment, cross_parsing, minhash, packing, quality, rans, secret_scan, simhash, successors, unigram_counts,
    prefix_trie, repeats, whitening,
)
from reviewlake.llm.shipping import prepare_session
from reviewlake.session import persist_reliably, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PACK_END_ID = 1
FILE_END_ID = 2


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A new folder for written output in the shared checkpoint folder.
scratch = scratch_path


@query("op1_mixture_packing")
def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens; one row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, PACK_END_ID, keep_ids=False)
    return pieces.select("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as coded token-id files and read back."""
    path = scratch(spark, "token-files")
    rans.write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE, FILE_END_ID)
    return rans.read_token_digests(spark, path)


@query("op8_simhash_groups")
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document: 4-word shingles, up to 4 of 64 bits."""
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), n=4, max_distance=4)


SQL_CONTAINED = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
  WHERE text IS NOT NULL),
item_sizes AS (SELECT item_id, w, least(5, len(w)) AS n FROM item_words WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM item_sizes)),
items AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
doc_sizes AS (SELECT doc_id, w, n FROM doc_words, (SELECT DISTINCT n FROM item_sizes) WHERE len(w) >= n),
doc_shingles AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_sizes)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (n, s)
  GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM shared JOIN items USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_item"""


@query("op10_benchmark_containment", SQL_CONTAINED)
def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain to at least 0.8 of their 5-word shingles."""
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_secret_spans")
def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and structurally confirmed encodings."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def learning_part(folds: int, held_out: int) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``folds``."""
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    return F.coalesce(rest == held_out, F.lit(False))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = cross_parsing.fit_profiles(docs.filter(~learning_part(5, 0)))
    return cross_parsing.predict(docs, profiles).select("doc_id", learning_part(5, 0).alias("held_out"), "lang_pred", "score")


@query("op7_minhash_fingerprints")
def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text, and its near-duplicates."""
    docs = table(spark, sf_dir, "documents")
    digits = ("edited_sha256", "fingerprint", "edited_fingerprint")
    with simhash.shuffle_files_removed(spark):
        rows = persist_reliably(successors.edited_fingerprints(docs).withColumns({c: F.unhex(c) for c in digits}))
    classes = minhash.text_classes(docs, rows=rows.select("doc_id", "digest", "fingerprint"))
    return minhash.with_classes(rows, "digest", classes).withColumns({c: F.lower(F.hex(c)) for c in digits})


@query("op2_unigram_token_counts")
def op2_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_escaped(c: str) -> str:
    """A backslash doubled, and one after the first character of every control string."""
    c = f"replace({c}, '\\', '\\\\')"
    for control in chat_format.CONTROLS:
        c = f"replace({c}, {_sql_text(control)}, {_sql_text(control[0] + chr(92) + control[1:])})"
    return c


_MARKS = len(chat_format.OPEN + chat_format.SEP + chat_format.CLOSE)
SQL_CHAT = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
joined AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum({_MARKS} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM joined"""


@query("op3_chat_format", SQL_CHAT)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with one that speaks control strings."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], own.schema)
    return chat_format.digests(chat_format.format_conversations(own.unionByName(added)))


@query("op6_quality_score")
def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels that are not held out."""
    docs, held_out = table(spark, sf_dir, "documents"), learning_part(4, 2)
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    vectors = quality.fit_vectors(docs)
    scored = quality.score(docs, vectors, quality.fit_network(docs, labels, vectors))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every embedding."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


_BIT = "[0, 0, 0, 0, 0, 0, 0, 0]"
#: CRC-32 of a decimal id: the bits of each character shifted through the polynomial.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), "
    "lambda ch: ascii(ch)::BIGINT)), lambda crc, byte: "
    f"list_reduce(list_prepend(xor(crc, byte), {_BIT}::BIGINT[]), "
    "lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
)
SQL_TRIE = f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS lender, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (SELECT ids.c, place, role, text FROM ids JOIN turns ON turns.c = ids.lender AND place <= h
  UNION ALL SELECT ids.c, place, role, text FROM ids JOIN turns USING (c) WHERE place > h),
paths AS (SELECT ids.c, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS path
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c),
members AS (SELECT c, path[1:d] AS node, d, d = len(path) AS ends
  FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(node[d].text) END AS own_saved
  FROM members GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
filled AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT node[1:k] AS node, own_saved, (n_children = 0)::BIGINT AS leaf
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM filled)),
subtrees AS (SELECT node, sum(own_saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM above GROUP BY node)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM filled f JOIN subtrees s USING (node) LEFT JOIN nodes p ON f.d > 0 AND p.node = f.node[1:f.d - 1]"""


@query("op12_prefix_trie", SQL_TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations with lent openings."""
    turns = prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_nodes(prefix_trie.with_lent_openings(turns))


SQL_REPEATS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, k, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT s, min(k) AS first_k FROM windows GROUP BY s HAVING min(k) < max(k)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE first_k < k),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)"""


@query("op11_substring_dedup", SQL_REPEATS)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words that an earlier one holds."""
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
