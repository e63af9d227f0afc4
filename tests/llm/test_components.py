"""Components of link tables against union-find, and how many tables they store."""

import random

from reviewlake.llm import components


def brute(links):
    root = {x: x for link in links for x in link}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def stored(monkeypatch):
    seen, whole = [], components.persist_reliably
    monkeypatch.setattr(components, "persist_reliably", lambda df: seen.append(1) or whole(df))
    return seen


def test_stars_take_no_step(spark, monkeypatch):
    """Links to the smallest node are recognised; no step is made only to see that nothing changes."""
    seen = stored(monkeypatch)
    links = [(10 * g + k, 10 * g) for g in range(-20, 20) for k in range(1, 8)] * 2
    found = components.connected_components(spark.createDataFrame(links, "node long, other long").repartition(8))
    assert sorted(map(tuple, found.collect())) == sorted(brute(links).items())
    assert len(seen) == 2


def test_any_links_equal_union_find(spark, monkeypatch):
    rng = random.Random(8)
    nodes = [rng.randrange(-(2**62), 2**62) for _ in range(150)]
    links = [tuple(rng.sample(nodes, 2)) for _ in range(90)] + [(nodes[0], nodes[0])]
    links += [(k, k + 1) for k in range(200)] + [(900, k) for k in range(300, 360)] + [(k, 290) for k in range(900, 950)]
    rng.shuffle(links)
    expected = brute([x for x in links if x[0] != x[1]])
    for most in (1 << 20, 7):
        monkeypatch.setattr(components, "LINKS", most)
        found = components.connected_components(spark.createDataFrame(links, "node long, other long").repartition(12))
        assert sorted(map(tuple, found.collect())) == sorted(expected.items())


def test_no_links(spark):
    none = spark.createDataFrame([(5, 5), (None, 3)], "node long, other long")
    assert components.connected_components(none).count() == 0
