"""Packing and token files against the tokenizer library and plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from reviewlake.llm import packing, queries, rans
from reviewlake.llm.token_ids import IdEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, task int, `group` int"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    """NULLs, empty, blank, repeated and very long texts, and clashing extra columns."""
    rng = random.Random(5)
    words = ["the", " of", "it's", "\n", "  ", "über", "漢字", "🎉", "x" * 40, "#", "1234", "\t"]
    texts = [None, "", " ", "#", "a\0b", "".join(rng.choice(words) for _ in range(30_000)), "the end", "the end"]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [
        Row(i - 2, t, "en", [None, "a", "b", "c"][i % 4], 0, "clash", 7, 9) for i, t in enumerate(texts)
    ]
    rows += [Row(5, "the end", "en", "a", 0, "clash", 7, 9), Row(None, "no id", None, None, 0, None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_memo_encoder_equals_library(library):
    signs = ["a", "Z", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "!", "$$", "漢", "🎉", "́",
             "\0", "<|endoftext|>", "ſ", "٣", " ", " ", " '", "\U0001fae8"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    small = IdEncoder(queries.BYTE_BPE, 2, memo_words=300)
    for encoder in (small, IdEncoder(queries.BYTE_BPE, 2)):
        ids, offsets = encoder.encode(texts)
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got == [[*library(t), 2] for t in texts]


def test_operators_equal_the_unaltered_library(spark, tmp_path):
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> \n<|endoftext|><|endoftext|>it's", "<|endoftext|", "the end"]
    texts += ["\U0001fae8 <|endoftext|>", "the cat " * 900 + "<|endoftext|>"]
    assert plain(texts[0]) == [64, 50256, 65]
    encode = IdEncoder(queries.BYTE_BPE, 2, match_special=True)
    ids, offsets = encode.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*plain(t), 2] for t in texts]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    check_pieces(packing.pack(docs, queries.BYTE_BPE, 1).collect(), list(enumerate(texts)), plain, 1)
    rans.write_token_files(docs, str(tmp_path / "files"), queries.BYTE_BPE, 2)
    got = {r["doc_id"]: r["ids"] for r in rans.read_token_files(spark, str(tmp_path / "files")).collect()}
    assert got == {i: [*plain(t), 2] for i, t in enumerate(texts)}


def check_pieces(pieces, texts, library, end_id, window=2048):
    """Each id in one piece, sequences gapless and full but for the last."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    expected = {}
    for doc_id, text in texts:
        ids = [*library(text), end_id]
        expected.setdefault((doc_id, len(ids)), []).append(ids)
    assert set(by_doc) == set(expected)
    for key, same in expected.items():
        if len(same) > 1:
            continue
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
            assert p["ids_crc32"] == crc(same[0][p["start"] : at])
        assert at == key[1]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    used = []
    for number in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[number]):
            assert offset == at and length > 0
            at += length
        used.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == window for n in used[:-1]) and 0 < used[-1] <= window


def test_packing_is_whole(odd_docs, library):
    pieces = packing.pack(odd_docs, queries.BYTE_BPE, 1).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    check_pieces(pieces, texts, library, 1)
    for p in pieces:
        assert crc(np.frombuffer(p["ids"], "<u2")) == p["ids_crc32"]


def test_windows_hold_target_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, queries.BYTE_BPE, 1, keep_ids=False).toPandas()
    held = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    share = held.sum() / held.to_numpy().sum()
    running = held.cumsum()
    for k in range(len(running) - 3):  # the last windows take the tails
        ideal = (k + 1) * packing.WINDOW * share
        assert (running.iloc[k] - ideal).abs().max() <= 3 * packing.GRAIN


def test_given_weights_hold_until_a_queue_ends(spark):
    rows = [(i, "the cat sat " * 50, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, queries.BYTE_BPE, 1, weights={"a": 3, "b": 1}, keep_ids=False).toPandas()
    held = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    early = held.iloc[: len(held) // 2]
    assert ((early["a"] - 1536).abs() <= packing.GRAIN).all()
    assert held["a"].sum() == held["b"].sum()


def test_deficits_carry_across_blocks():
    plan = packing.Plan(np.array([700_000, 40_000, 333, 64 * 900]), np.array([700_000.0, 40_000, 333, 57_600]), block_windows=8)
    ideal = plan.grains / plan.total_grains
    seen = np.zeros(4, dtype=int)
    for number in range(-(-plan.total_grains // (8 * 32))):
        served, _ = plan.block(number)
        assert (served[0] == seen).all()
        for row in served:
            assert (np.abs(row - row.sum() * ideal) <= 2).all()
        seen = served[-1]
    assert (seen == plan.grains).all()


def test_many_sources_share_the_last_queue(odd_docs, library):
    pieces = packing.pack(odd_docs, queries.BYTE_BPE, 1, max_queues=2).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    check_pieces(pieces, texts, library, 1)


def test_small_sources_keep_their_shares(spark, library):
    rows = [(i, "the cat sat " * 60, "big" if i % 6 < 5 else f"s{i // 6 % 12}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, queries.BYTE_BPE, 1, max_queues=4)
    check_pieces(pieces.collect(), [r[:2] for r in rows], library, 1)
    held = pieces.toPandas().pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    assert held.shape[1] == 13
    ideal = held.to_numpy().sum(axis=1).cumsum()[:, None] * (held.sum() / held.to_numpy().sum()).to_numpy()
    assert np.abs(held.cumsum().to_numpy() - ideal)[:-3].max() <= 4 * packing.GRAIN
    given = packing.pack(docs, queries.BYTE_BPE, 1, weights={"big": 1, "s3": 1}, max_queues=3, keep_ids=False).toPandas()
    early = given[given.sequence_id < 3].groupby("source").length.sum()
    assert abs(early["s3"] - early["big"]) <= 2 * packing.GRAIN and early.sum() == 3 * packing.WINDOW


def test_grains_of_a_shared_queue_are_dealt_once():
    tokens = np.array([64 * 300 + 5, 7, 64 * 300 + 5, 64, 64 * 7 + 63, 999])
    shared = packing.SharedQueue(tokens)
    seen = np.zeros(int(tokens.sum()), dtype=int)
    for member, n in enumerate(tokens.tolist()):
        for begin in range(0, n, 100):
            at = 0
            for start, length, place in shared.pieces(member, begin, min(n, begin + 100)):
                assert start == at and length > 0
                seen[place : place + length] += 1
                at += length
            assert at == min(n, begin + 100) - begin
    assert (seen == 1).all()


def test_token_files_round_trip(spark, odd_docs, library, tmp_path):
    path = str(tmp_path / "files")
    rans.write_token_files(odd_docs, path, queries.BYTE_BPE, 2)
    got = rans.read_token_files(spark, path).orderBy("start").collect()
    docs = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(docs)
    at = 0
    for row in got:
        assert row["start"] == at and row["n_tokens"] == len(row["ids"])
        at += row["n_tokens"]
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))
    expected = sorted(((r["doc_id"], [*library(r["text"]), 2]) for r in docs), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == expected
    digests = {r["start"]: r["ids_crc32"] for r in rans.read_token_digests(spark, path).collect()}
    assert all(digests[r["start"]] == crc(r["ids"]) for r in got)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 300_000])
def test_block_parts_decode_alone(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
    values, counts = np.unique(np.append(ids, [3, 3, 9]), return_counts=True)
    table = rans.frequency_table(values, rans.scaled_frequencies(values, counts))
    assert int(table.frequency.sum()) == 1 << rans.SCALE_BITS
    payload = rans.encode_block(ids, np.array([4]), np.array([n]), table)
    block = rans.open_block(payload, table)
    parts = [rans.decode_part(block, k, table) for k in reversed(range(len(block.checkpoints)))][::-1]
    assert np.array_equal(np.concatenate([np.zeros(0, int), *parts]), ids)
    damaged = payload[:-9] + bytes([payload[-9] ^ 1]) + payload[-8:]
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(damaged, table)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(empty, queries.BYTE_BPE, 1).count() == 0
    path = str(tmp_path / "none")
    rans.write_token_files(empty, path, queries.BYTE_BPE, 2)
    assert rans.read_token_files(spark, path).count() == 0


def test_queries_equal_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_token_files"](spark, sf_dir).collect()}
    at = 0
    for doc in docs:
        ids = [*library(doc["text"]), 2]
        row = rows[doc["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    pieces = queries.QUERIES["op1_mixture_packing"](spark, sf_dir).collect()
    check_pieces(pieces, [(d["doc_id"], d["text"]) for d in docs], library, 1)
