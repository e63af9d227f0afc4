"""Containment search against all pairs in plain Python, and against SQL."""

import random
import re

import pytest
from compare import compare, duck

from reviewlake.llm import containment, queries


def shingles(text, n):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items):
    out = []
    for item_id, item in items:
        n = min(5, len(re.findall(r"[^\W_]+", (item or "").lower())))
        own = shingles(item or "", n) if n else set()
        for doc_id, text in docs:
            shared = len(own & shingles(text or "", n)) if own else 0
            if own and shared >= 0.8 * len(own):
                out.append((doc_id, item_id, shared, len(own)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, n_item int")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = containment.contained_items(d.repartition(3), b)
    rows = [(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got.collect()]
    assert sorted(rows, key=str) == plain(docs, items)
    return rows


def test_edges(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, "Ünï, Cödé! 漢字 x1 y2 z3"), (103, items[3][1]), (None, items[4][1])]
    docs = [(1, None), (2, ""), (3, "w1"), (None, items[5][1])]
    for i in range(120):
        filler = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        inside = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.randint(0, 3)):  # a few words differ: near and below the threshold
            if inside:
                inside[rng.randrange(len(inside))] = "changed"
        at = rng.randint(0, len(filler))
        docs.append((10 + i, ", ".join(filler[:at] + inside + filler[at:])))
    docs.append((500, " ".join(rng.choice(words) for _ in range(50_000)) + " ünï cödé 漢字 x1 y2 z3"))
    docs.append((500, docs[-1][1]))
    assert len(check(spark, docs, items)) > 50


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_SHINGLES", 20)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(9)]
    docs = [(i, f"before {items[i][1]} after") for i in range(9)]
    assert len(check(spark, docs, items)) == 9


def test_sketch_cannot_miss():
    for n in range(1, 400):
        size = containment.sketch_size(n, 0.8)
        allowed_to_miss = n - next(k for k in range(n + 1) if k >= 0.8 * n)
        assert size == n or size > allowed_to_miss


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert containment.contained_items(docs, items).count() == 0
    assert containment.contained_items(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert "op10_benchmark_containment" in queries.ORACLE
    assert compare(spark, duck(sf), sf, "op10_benchmark_containment") == ""
