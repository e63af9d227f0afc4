"""Removal of repeated passages against plain Python over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import compare, duck

from reviewlake.llm import queries, repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=13):
    """(doc_id, n_words, n_removed, spans, kept) of rows (doc_id, text)."""
    first, split = {}, []
    for doc_id, text in rows:
        key = repeats.LAST if doc_id is None else doc_id
        words = WORDS.findall(text or "")
        split.append((doc_id, key, words))
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, key), key)
    out = []
    for doc_id, key, words in split:
        gone = {p for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < key for p in range(i, i + window)}
        spans = [p for p in range(len(words) + 1) if (p in gone) != (p - 1 in gone)]
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((doc_id, len(words), len(gone), list(zip(spans[::2], spans[1::2], strict=True)), kept))
    return sorted(out, key=str)


def check(spark, rows, window=13, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, block int")
    got = repeats.without_repeats(docs, window, **options).collect()
    found = [(r["doc_id"], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept"]) for r in got]
    assert sorted(found, key=str) == plain(rows, window)
    return found


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_substring_dedup"](spark, sf_dir).collect()
    expected = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, _, kept in plain(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(r["n_removed"] for r in got) > 0


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), sf_dir, "op11_substring_dedup") == ""


def mixed_rows(seed, n=120):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    passages = [rng.choices(pool, k=rng.randint(5, 40)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else rng.choices(pool, k=rng.randint(0, 20))
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "  ", "\n", "\t\x0b"]).join(words)))
    rows += [rows[3]] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [0, 3, 1 << 14])
def test_small_blocks_shards_and_automata(spark, monkeypatch, seed, hot):
    for name, value in (("BLOCK_BYTES", 700), ("BUCKET_BYTES", 3000), ("SHARD_BYTES", 2000), ("AUTOMATON_WORDS", 50), ("MAX_RUN", 3), ("CHUNK_BYTES", 300)):
        monkeypatch.setattr(repeats, name, value)
    check(spark, mixed_rows(seed), hot=hot)


def test_odd_rows(spark):
    base = " ".join(f"v{i}" for i in range(40))
    rows = [
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, " ".join(["a"] * 12)), (10, " ".join(["a"] * 5000)), (3, " ".join(["a"] * 14)),
        (11, base), (12, base), (12, base + " tail"), (2, "head " + base), (None, base), (None, base), (1, base.upper()),
        (20, "x" * 300_000 + " " + base), (21, "nul\0nul é\x85é \x1cu " + base), (-4, " ".join(["wide"] * 30)), (-3, " ".join(["wide"] * 30)),
        (30, " ".join(f"n{i % 7919}" for i in range(60_000))), (31, " ".join(f"n{i % 7919}" for i in range(7000, 30_000))),
    ]
    found = check(spark, rows)
    assert any(r[2] for r in found)


def test_other_windows(spark):
    for window in (5, 6, 8, 21):
        check(spark, mixed_rows(window, 60), window)
    with pytest.raises(ValueError):
        repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string"), 4)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automaton_gives_first_documents_of_all_windows(seed):
    rng = random.Random(seed)
    sequences = [rng.choices(range(3), k=rng.randint(4, 40)) for _ in range(40)]
    documents = [rng.randint(-5, 30) for _ in sequences]
    automaton = repeats.Automaton(sequences, documents, 4)
    for words in [*sequences, *(rng.choices(range(4), k=30) for _ in range(20)), []]:
        expected = []
        for i in range(len(words) - 3):
            w = words[i : i + 4]
            held = [d for s, d in zip(sequences, documents, strict=True) if any(s[j : j + 4] == w for j in range(len(s)))]
            expected.append(min(held, default=repeats.LAST))
        assert automaton.first_documents(words) == expected


def test_words_end_where_texts_do():
    texts = [b"ab", b"", b"cd e", b" f", b"g\xc2\x85h"]
    hashes, offsets = repeats.word_hashes(texts)
    assert np.diff(offsets).tolist() == [1, 0, 2, 1, 1]
    assert hashes[0] == repeats.word_hashes([b" ab\n"])[0][0]
    assert len(set(hashes.tolist())) == 5
