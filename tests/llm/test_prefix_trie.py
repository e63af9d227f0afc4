"""The prefix trie against plain Python over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import compare, duck

from reviewlake.llm import prefix_trie, queries
from reviewlake.llm.prefix_trie import WIDTH, ZFastTrie, two_fattest


def plain_nodes(paths):
    """Rows of the result from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = {}
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[n] for n in below)
        row = (min(ids), len(node), parent, len(ids), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        out[node] = row
    return sorted(out.values(), key=str)


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in turns.items()}
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(lender, [])[:h] + path[h:]
    return out


def check(spark, rows, schema="conv_id long, turn long, role string, text string"):
    frame = spark.createDataFrame(rows, schema)
    got = prefix_trie.trie_nodes(prefix_trie.with_lent_openings(prefix_trie.turn_rows(frame))).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(plain_rebuilt([r[:4] for r in rows]))


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), sf_dir, "op12_prefix_trie") == ""


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_prefix_trie"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(plain_rebuilt(rows))


@pytest.mark.parametrize("range_turns", [1, 7, 40, 10**6])
def test_ranges_of_any_size_give_the_same_nodes(spark, monkeypatch, range_turns):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", range_turns)
    monkeypatch.setattr(prefix_trie, "IDS_A_CHUNK", 3)
    rng = random.Random(range_turns)
    texts = ["", "a", "hello there", "ünïcode", "long " * 30]
    rows = []
    for c in range(-12, 60):
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(texts[: 1 + t % 5])))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 2, "", "y"), (1, 1, "user", "x"),
        (7, 5, "a", "b" * 300_000), (None, 1, "user", "nobody"), (2**40, 1, "us", "er"), (2**40 + 1, 1, "u", "ser"), (-3, 1, "user", "x"),
    ]
    rows += [(10, t, "user", f"t{t}") for t in range(700)]
    rows += [(c, t, "user", "same") for c in range(20, 60) for t in range(12)]
    check(spark, [(*r, b"clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest binary, place int")


def test_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 1, "user", "x")]):
        turns = prefix_trie.turn_rows(spark.createDataFrame(rows, schema))
        assert prefix_trie.trie_nodes(prefix_trie.with_lent_openings(turns)).count() == 0


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda f: f & -f)


def chain(turns):
    path = b""
    for i in range(len(turns)):
        path += hashlib.md5(repr(turns[: i + 1]).encode()).digest()
    return path


@pytest.mark.parametrize("seed", range(4))
def test_exit_nodes_by_fat_search_equal_plain_search(seed):
    rng = random.Random(seed)
    words = sorted({tuple(rng.choices("ab", k=rng.randint(0, 40)))[: rng.randint(0, 40)] for _ in range(600)})
    words += [w[:9] + tuple("a" * 200) for w in words[::50] if w[:9] + tuple("a" * 200) not in words]
    rng.shuffle(words)
    words = list(dict.fromkeys(words))
    trie = ZFastTrie()
    trie.insert([(chain(w), i, 1) for i, w in enumerate(words)])
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    for w in [*words, *(tuple(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(500))]:
        path = chain(w)
        node, shared = trie.exit_of(path)
        assert shared == max(d for d in range(len(w) + 1) if w[:d] in prefixes)
        assert node.low < shared <= node.high
        assert shared == 0 or node.path[: WIDTH * shared] == path[: WIDTH * shared]
    assert sum(n.ending for n in trie.from_leaves()) == len(words)
