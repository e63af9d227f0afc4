"""SimHash groups against a comparison of all pairs in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from reviewlake.llm import queries, simhash
from reviewlake.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> smallest reachable doc_id over all pairs of fingerprints."""
    values = sorted({f for _, f in rows})
    parent = {f: f for f in values}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    array = np.array(values, dtype=np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4):
            parent[top(values[i + 1 + j])] = top(f)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[top(f)] = min(least.get(top(f), doc_id), doc_id)
    return {(doc_id, f): least.get(top(f)) for doc_id, f in rows}


def check(spark, docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    expected = plain_components(rows)
    got = simhash.near_duplicate_groups(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted(
        (d is None, d or 0, f"{f:016x}") for d, f in rows
    )
    for r in got:
        assert r["component_id"] == expected[(r["doc_id"], int(r["fingerprint"], 16))]
    return got


def test_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(spark, docs)
    again = queries.QUERIES["op8_simhash_groups"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert any(r["doc_id"] != r["component_id"] for r in got)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "é É", "a\x1cb c", base, base, base + " tail",
             base.upper(), "x" * 5000, " ".join(["again"] * 3000)]
    rows = [(i * 7 - 3, t, "clash", i) for i, t in enumerate(texts)]
    rows += [(4, "one", "clash", 0), (None, base, "clash", 0), (4, "one", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, root int")
    check(spark, docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(docs).count() == 0
    assert simhash.keep_one_of_each_group(docs).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_connect_all_near_fingerprints(spark, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(150)}
    for f in list(values)[:40]:
        for _ in range(6):
            values.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    values = sorted(values)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"), distance)
    pairs = [(r["node"] % (1 << 64), r["other"] % (1 << 64)) for r in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in pairs)

    def classes(edges):
        parent = {f: f for f in values}

        def top(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in edges:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in values}

    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= distance]
    assert classes(pairs) == classes(near)


def test_bucket_hash_is_linear():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert (simhash.bucket_of(a ^ b, 11) == simhash.bucket_of(a, 11) ^ simhash.bucket_of(b, 11)).all()
    assert len(simhash.ball(2)) == 2081


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    roots = dict(connected_components(spark.createDataFrame(edges, "node long, other long")).collect())
    expected = {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 150), 200]} | {300: 300, 301: 300}
    assert roots == expected


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text, 1), (5, text, 2), (5, text, 3), (7, text.upper(), 4), (8, "other words here", 5), (None, "no id", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 5, 8]


def plain_kept(rows):
    """What stays of rows (doc_id, text): the smallest key of each component, once."""
    marks = [plain_fingerprint(t) for _, t in rows]
    members = {}
    # Components of fingerprints, named by any id: every fingerprint its own row number.
    roots = plain_components(list(enumerate(marks)))
    for i, ((doc_id, text), f) in enumerate(zip(rows, marks, strict=True)):
        key = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).digest()
        members.setdefault(roots[(i, f)], []).append((doc_id is None, doc_id or 0, key, text))
    return [(None if m[0] else m[1], m[3]) for m in (min(g, key=lambda m: m[:3]) for g in members.values())]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=300)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c), (None, c), (None, a), (9, None), (9, ""), (3, b + " x"), (8, "one")]
    rows += [(8, "one")] * 4 + [(11, "one"), (None, "alone here"), (6, c * 40)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, _kept string, root int")
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str)
    assert [(d, t or "") for d, t in got] == sorted([(d, t or "") for d, t in plain_kept(rows)], key=str)
    texts = {t for _, t in got}
    assert a in texts and (c in texts or c * 40 in texts) and (b in texts or b + " x" in texts)
