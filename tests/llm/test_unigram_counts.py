"""Counts against the ``tokenizers`` library's Unigram model with the same vocabulary."""

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from reviewlake.llm import queries, unigram_counts as uc

SIGNS = ["a", "b", "ab", "the", " ", "  ", "\n", "é", "漢", "🎉", "\t", "x" * 9, ".", ",", "ing", "▁", "0", "́", "tion"]


def library(vocabulary, byte_fallback):
    entries = [("<unk>", 0.0), *vocabulary.items()]
    if byte_fallback:
        entries += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    model = models.Unigram(entries, unk_id=0, byte_fallback=byte_fallback)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def texts(seed, n=3000):
    rng = random.Random(seed)
    return ["", " ", "a", *("".join(rng.choices(SIGNS, k=rng.randint(0, 25))) for _ in range(n))]


@pytest.mark.parametrize("scores", ["zipf", "file"])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_library(scores, byte_fallback):
    vocabulary = uc.sentencepiece_vocabulary(queries.PIECES, scores)
    expected = library(vocabulary, byte_fallback)
    counter = uc.UnigramCounter(vocabulary, byte_fallback)
    for text in texts(1):
        assert counter.count(text) == expected(text), text


@pytest.mark.parametrize("seed", range(6))
def test_ties_follow_the_library(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(30)}
    vocabulary = {p: float(-rng.randint(1, 3)) for p in sorted(pieces)}  # many equal sums
    for byte_fallback in (True, False):
        expected, counter = library(vocabulary, byte_fallback), uc.UnigramCounter(vocabulary, byte_fallback)
        for _ in range(1500):
            text = "".join(rng.choices("aabb c", k=rng.randint(0, 14)))
            assert counter.count(text) == expected(text), (text, vocabulary)


def test_query_equals_library(spark, sf_dir):
    expected = library(uc.sentencepiece_vocabulary(queries.PIECES), True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_unigram_token_counts"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert (got[d["doc_id"]]["n_chars"], got[d["doc_id"]]["n_tokens"]) == (len(d["text"]), expected(d["text"]))


def test_odd_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "a" * 200_000, "c"), (None, "the cat", "c"), (4, "the", "c"), (4, "the", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = uc.token_counts(docs, queries.PIECES).collect()
    assert len(got) == 6 and sum(r["n_tokens"] for r in got if r["doc_id"] in (1, 2)) == 0
    assert uc.token_counts(docs.limit(0), queries.PIECES).count() == 0
