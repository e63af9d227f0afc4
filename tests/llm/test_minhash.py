"""Fingerprints and their likeness against plain Python."""

import hashlib
import random

import numpy as np

from reviewlake.llm import minhash, queries, successors


def jaccard(a, b, n=5):
    def shingles(t):
        words = t.split()
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def plain_edits(rows):
    """(doc_id, text, edited, next text) in descending doc_id, ties by text, NULL last."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + following[:half], following


def check(spark, rows, got):
    expected = sorted(
        ((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in plain_edits(rows)), key=str
    )
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected
    by_edit = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for doc_id, text, edit, following in plain_edits(rows):
        r = by_edit[(doc_id, hashlib.sha256(edit.encode()).hexdigest())]
        one, two, three = minhash.signatures([text, edit, following])
        assert r["fingerprint"] == minhash.written(one[None])[0]
        assert r["edited_fingerprint"] == minhash.written(two[None])[0]
        assert abs(r["near_edited"] - jaccard(text, edit)) < 0.25
        assert r["near_next"] == minhash.likeness(one[None], three[None])[0]


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_minhash_fingerprints"](spark, sf_dir).collect()
    check(spark, rows, got)
    errors = [r["near_edited"] - jaccard(t, e) for (d, t, e, _), r in zip(plain_edits(rows), sorted(got, key=lambda r: -r["doc_id"]))]
    assert np.abs(errors).mean() < 0.05


def brute_components(rows):
    """The smallest doc_id that each one reaches over equal texts and a similarity of 0.8."""
    root = {d: d for d, _ in rows}

    def find(d):
        return d if root[d] == d else find(root[d])

    def shingles(t):
        words = t.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(d, t or "", shingles(t or "")) for d, t in rows]
    for i, (d, t, x) in enumerate(sets):
        for e, u, y in sets[:i]:
            if find(d) != find(e) and (t == u or (x and len(x & y) >= 0.8 * len(x | y))):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in root}


def test_query_groups_equal_brute_force(spark, tmp_path, sf_dir):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for d, t in rows[:60]:
        words = (t or "").split()
        for k in range(2):
            if len(words) > 8:
                words[rng.randrange(len(words))] = f"new{k}"
            rows.append((10_000 + 2 * d + k, " ".join(words)))
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op7_minhash_fingerprints"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    least = {}
    for d, t in sorted(rows):
        least.setdefault(t or "", d)
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: least[t or ""] for d, t in rows}


def test_one_id_on_many_rows(spark):
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words)
    rows = [(7, text)] * 50 + [(7, "other text of the same id"), (3, text + " end"), (9, "other text of the same id"), (None, text), (None, "lone")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, class_id int").repartition(5)
    got = {tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "class_id", "component_id").collect()}
    assert got == {(7, 7, 3), (3, 3, 3), (9, 7, 3), (None, 7, 3), (None, None, None)}
    assert minhash.near_duplicates(docs).count() == len(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "é漢🎉 zwei", "a b c d", "a b c d e", "w " * 20_000, "same text here", "same text here"]
    texts += [" ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(4, "tie b"), (4, "tie a"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, range string, key int")
    check(spark, rows, successors.edited_fingerprints(docs.repartition(4)).collect())


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert successors.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    alone = successors.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1.0


def test_likeness_estimates_similarity():
    words = [f"w{i}" for i in range(2000)]
    for kept in (2000, 1500, 1000, 300):
        other = words[:kept] + [f"x{i}" for i in range(2000 - kept)]
        one, two = minhash.signatures([" ".join(words), " ".join(other)])
        assert abs(minhash.likeness(one[None], two[None])[0] - jaccard(" ".join(words), " ".join(other))) < 0.15
    empty, other = minhash.signatures(["", "x"])
    assert minhash.likeness(empty[None], other[None])[0] == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(200)]
        for copy in range(rng.randint(1, 6)):
            words = list(base)
            if copy > 1:
                words[rng.randrange(200)] = f"changed{copy}"
            rows.append((len(rows), " ".join(words)))
            truth.setdefault(group, []).append(len(rows) - 1)
    rows += [(900, None), (901, ""), (902, "a b")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert all(got[d] == min(members) for members in truth.values() for d in members)
    assert got[900] == got[901] == 900 and got[902] == 902
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    columns = minhash.fingerprints(docs).alias("a").crossJoin(minhash.fingerprints(docs.filter("doc_id = 0")).alias("b"))
    alike = columns.select("a.doc_id", minhash.similarity("a.fingerprint", "b.fingerprint").alias("s")).collect()
    assert {r["doc_id"] for r in alike if r["s"] > 0.7} == {d for d in truth[0]}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(40):
            words, start, size = list(base), rng.randrange(100), rng.randint(0, 30)
            words[start : start + size] = [f"x{rng.random()}" for _ in range(size)]
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[3]), (501, texts[3]), (502, " "), (503, None), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {d: d for d, _ in rows if d is not None}

    def find(d):
        return d if root[d] == d else find(root[d])

    known = [(d, t) for d, t in rows if d is not None and (t or "").strip()]
    for i, (d, t) in enumerate(known):
        for e, u in known[:i]:
            if find(d) != find(e) and jaccard(t, u) >= 0.8:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    for block_rows in (2048, 8):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, block_rows=block_rows).collect()}
        assert got.pop(None) is None
        assert got == {d: find(d) for d in root}


def test_like_pairs_across_roots_are_all_found(spark):
    texts = [" ".join(f"w{i}" for i in range(100)) + f" end{k}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = minhash.fingerprints(docs).withColumnRenamed("doc_id", "class_id")
    banded = minhash._banded(signed, 32).selectExpr("*", "class_id % 3 AS root")
    expected = {(a, b) for a in range(60) for b in range(a) if a % 3 != b % 3}
    for block_rows in (2048, 7):
        got = [tuple(r) for r in minhash._pairs_apart(banded, 0.6, block_rows).collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_alike_texts_below_the_threshold_are_verified_where_they_meet(spark, monkeypatch):
    """Many pairs of different components must not become rows of a join."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(0, 150, 12), 4):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(100, texts[7] + " end"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verified, late = [], []
    for name, seen in (("_verified", verified), ("_links_apart", late)):
        whole = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda first, *rest, whole=whole, seen=seen: seen.append(first.count()) or whole(first, *rest))
    for block_rows, shingles in ((2048, 1 << 22), (8, 100)):
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, block_rows=block_rows).collect()}
        assert got == brute_components(rows)
    assert len(verified) == len(late) == 2
    assert all(n <= 2 * 32 * len(rows) for n in verified) and all(0 < n <= 32 * len(rows) for n in late)


def test_late_links_join_roots(spark):
    """Links of the late comparison are of roots, so that components are not made of all links again."""
    texts = [" ".join(f"w{i}" for i in range(100)) + f" end{k}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = minhash.fingerprints(docs).withColumnRenamed("doc_id", "class_id")
    sets = minhash.shingle_sets(docs, 5).withColumnRenamed("doc_id", "class_id")
    banded = minhash._banded(signed, 32).selectExpr("*", "class_id % 3 AS root").join(sets, "class_id")
    for block_rows in (2048, 5):
        got = {tuple(r) for r in minhash._links_apart(banded, 0.8, block_rows).collect()}
        assert got <= {(1, 0), (2, 0), (2, 1)} and len(got) >= 2
