"""Connected components of a link table, as a sequence of Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.session import persist_reliably

#: Links that a task joins at a time.
LINKS = 1 << 20


def stars(node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that is not the smallest of its component, sorted by node."""
    names, flat = np.unique(np.concatenate([node, other]), return_inverse=True)
    one, two = flat[: len(node)], flat[len(node) :]
    root = np.arange(len(names))
    while (apart := root[one] != root[two]).any():
        one, two = one[apart], two[apart]
        a, b = root[one], root[two]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    linked = np.flatnonzero(root != np.arange(len(names)))
    return names[linked], names[root[linked]]


def _joined(links: DataFrame, most: int = 0) -> DataFrame:
    """Links (node, other) with the same components, those that a task reads together as stars.

    A task holds ``most`` links at a time. The last node stays for the next ones, so that where
    links are sorted by node, all those of a node are brought together.
    """
    most = most or LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= most:
                last = held[-1][0, -1:]
                node, root = stars(*np.concatenate(held, axis=1))
                yield pa.record_batch([pa.array(node), pa.array(root)], names=["node", "other"])
                held = [np.stack([last, root[node == last]])] if last in node else []
        if held:
            yield pa.record_batch([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], names=["node", "other"])

    return links.mapInArrow(run, "node long, other long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node it reaches.

    ``links`` has the columns ``node`` and ``other``. Large-star and small-star steps alternate
    until all links are stars. A large star moves each link to the least node above its end. A
    small star deals links by node and brings the ends of a node's links under the smallest. Links
    are joined where they are read first, so a node has one link of each task at most and none is
    hot. Each step is stored, so a lost executor costs one step. The number of steps grows with
    the logarithm of the longest path.
    """
    links = links.select(F.col("node").cast("long"), F.col("other").cast("long")).filter("node != other")
    larger, smaller = F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")
    edges = persist_reliably(_joined(links.select(larger, smaller)))
    while True:
        ways = F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other")))
        smallest, below = F.least("node", F.min("other")).alias("root"), F.max(F.when(F.col("other") < F.col("node"), F.col("other")))
        ends = edges.select(F.inline(ways)).groupBy("node").agg(smallest, below.alias("most"))
        ends = persist_reliably(ends)
        above = ends.filter("root < node").select(F.col("node").alias("other"), "root")
        if ends.filter("root < most").isEmpty() and edges.join(above, "other", "left_semi").isEmpty():
            return ends.select("node", "root")
        large = edges.join(above, "other", "left").select("node", F.coalesce("root", "other").alias("other"))
        edges = persist_reliably(_joined(_joined(large).repartition("node").sortWithinPartitions("node")))
