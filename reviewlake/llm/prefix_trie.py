"""Conversation prefixes in a z-fast trie.

A conversation is a path of turns. A turn is known by its MD5, and a prefix by the 128-bit hash
chain of its turns, so the hash of the first ``d`` turns is the name of a node. A z-fast trie
stores compacted nodes only (branches and ends) in a hash table, each under its *handle*: the
prefix at the two-fattest depth of its edge, the depth on the edge that is divisible by the
largest power of two. The exit node of a conversation, where it leaves the trie, is found by a
fat binary search of ``log2(turns)`` look-ups. Conversations are located in batches and then
inserted, and at the end every edge is expanded to one node per turn.

Equal conversations are one path with a count. Paths are range-partitioned by their hash chains,
so a task holds neighbours, and a first turn that very many conversations share is cut into as
many ranges as its paths need. Every task builds the trie of its range. Only prefixes of its
least and its greatest path can also occur in other ranges: those *open* nodes, two paths a
task, are merged by their hash in Spark, and sums over their subtrees run along the two paths of
each range. All other nodes are complete as they leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from reviewlake.session import persist_reliably

#: A turn or a prefix is known by this many bytes.
WIDTH = 16
#: Paths located in the trie before they are inserted.
BATCH = 256
#: Turns of distinct paths in a range; ranges are at least as many as the session's cores.
RANGE_TURNS = 200_000
#: Ids that are joined to one string before the strings of a path's end meet.
IDS_A_CHUNK = 4096
ROOT = b"\0" * WIDTH
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
#: What a range gives for each node. ``open`` nodes may occur in other ranges; their last three
#: sums hold only what hangs below them that is complete.
_NODES = (
    "digest binary, parent binary, part int, open boolean, lower boolean, upper boolean, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, bytes long, n_children long, n_leaves long, saved_tokens long"
)


def two_fattest(low: int, high: int) -> int:
    """The number in ``(low, high]`` that is divisible by the largest power of two."""
    return high & -1 << ((low ^ high).bit_length() - 1)


@dataclass(eq=False)
class Node:
    """A compacted node: the prefixes of ``path`` longer than ``low`` turns, up to ``high``."""

    path: bytes
    low: int
    high: int
    parent: Node | None
    children: list[Node] = field(default_factory=list)
    #: Members that end here, and of the whole subtree their number and smallest id.
    ending: int = 0
    members: int = 0
    least: int | None = None
    #: Of the edge's first node, if complete: one child of the node above, its leaves and savings.
    kids: int = 0
    leaves: int = 0
    saved: int = 0


def prefix(path: bytes, depth: int) -> bytes:
    """The name of the node at ``depth`` of a path."""
    return path[WIDTH * (depth - 1) : WIDTH * depth] if depth else ROOT


class ZFastTrie:
    """Compacted trie of paths, with its nodes hashed at their handles."""

    def __init__(self) -> None:
        self.root = Node(b"", -1, 0, None)
        self.handles: dict[bytes, Node] = {}
        #: A child is entered by the prefix one turn beyond its parent's end.
        self.entries: dict[bytes, Node] = {}
        self.changes = 0

    def exit_of(self, path: bytes) -> tuple[Node, int]:
        """The node where ``path`` leaves the trie, and how many turns it shares with the trie.

        A node whose whole extent is shared is its own exit; otherwise the path leaves on the
        node's edge.
        """
        length = len(path) // WIDTH
        at, low, high = self.root, 0, length
        while low < high:
            fat = two_fattest(low, high)
            node = self.handles.get(prefix(path, fat))
            if node is None:
                high = fat - 1
            elif node.high <= length and prefix(path, node.high) == prefix(node.path, node.high):
                at, low = node, node.high
            else:
                return node, self._shared(node, path, fat, min(node.high, length))
        if low < length:
            node = self.entries.get(prefix(path, low + 1))
            if node is not None:
                return node, self._shared(node, path, low + 1, min(node.high, length))
        return at, low

    @staticmethod
    def _shared(node: Node, path: bytes, known: int, most: int) -> int:
        """The longest common prefix of a path and a node's extent, between two depths."""
        while known < most:
            middle = (known + most + 1) // 2
            if prefix(path, middle) == prefix(node.path, middle):
                known = middle
            else:
                most = middle - 1
        return known

    def insert(self, paths: list[tuple[bytes, int, int]]) -> None:
        """Insert (path, smallest id, count) in batches; paths must differ."""
        for begin in range(0, len(paths), BATCH):
            batch = paths[begin : begin + BATCH]
            located, changed = [self.exit_of(path) for path, _, _ in batch], set()
            for (path, least, count), (node, shared) in zip(batch, located, strict=True):
                if node in changed:
                    node, shared = self.exit_of(path)
                changed |= self._add(path, least, count, node, shared)

    def _store(self, node: Node) -> None:
        self.handles[prefix(node.path, two_fattest(node.low, node.high))] = node
        self.entries[prefix(node.path, node.low + 1)] = node

    def _add(self, path: bytes, least: int, count: int, node: Node, shared: int) -> set[Node]:
        """Insert one path at its exit; returns the nodes at which others may now exit elsewhere."""
        changed = {node}
        if shared < node.high:
            del self.handles[prefix(node.path, two_fattest(node.low, node.high))]
            upper = Node(node.path, node.low, shared, node.parent, [node])
            node.parent.children[node.parent.children.index(node)] = upper
            node.parent, node.low = upper, shared
            self._store(upper)
            self._store(node)
            node = upper
            changed.add(node)
        if shared * WIDTH < len(path):
            leaf = Node(path, shared, len(path) // WIDTH, node)
            node.children.append(leaf)
            self._store(leaf)
            node = leaf
        node.ending, node.least = count, least
        return changed

    def from_leaves(self) -> list[Node]:
        """All nodes, each after its children."""
        order = [self.root]
        for node in order:
            order += node.children
        return order[::-1]


def shared_turns(path: bytes, other: bytes, most: int) -> int:
    """How many of the first ``most`` turns of ``path`` begin ``other`` too."""
    low, high = 0, min(most, len(other) // WIDTH)
    while low < high:
        middle = (low + high + 1) // 2
        if prefix(path, middle) == prefix(other, middle):
            low = middle
        else:
            high = middle - 1
    return low


def expanded_nodes(paths: list[tuple[bytes, list[int], int, int]], part: int) -> Iterator[tuple]:
    """Rows of ``_NODES`` of one range of different paths: (path, bytes per turn, smallest id, count)."""
    trie = ZFastTrie()
    trie.insert([(path, least, count) for path, _, least, count in paths])
    sizes = {path: turn_bytes for path, turn_bytes, _, _ in paths}
    borders = min(sizes), max(sizes)
    nodes = trie.from_leaves()
    for node in nodes:
        node.members = node.ending + sum(c.members for c in node.children)
        node.least = min(x for x in (node.least, *(c.least for c in node.children)) if x is not None)
    for node in nodes:
        lower_to, upper_to = (shared_turns(node.path, border, node.high) for border in borders)
        kids, leaves, saved = (sum(x) for x in zip((0, 0, 0), *((c.kids, c.leaves, c.saved) for c in node.children), strict=True))
        for depth in range(node.high, node.low, -1):
            size = sizes[node.path][depth - 1] if depth else 0
            is_open = depth <= max(lower_to, upper_to)
            if not is_open:
                leaves = leaves if kids else 1
                saved += (node.members - 1) * size
            above = node.least if depth - 1 > node.low or node.parent is None else node.parent.least
            name, parent = prefix(node.path, depth), prefix(node.path, depth - 1) if depth else None
            places = (part, is_open, depth <= lower_to, depth <= upper_to, depth)
            yield (name, parent, *places, node.least, above, node.members, size, kids, leaves, saved)
            kids, leaves, saved = (0, 0, 0) if is_open else (1, leaves, saved)
        node.kids, node.leaves, node.saved = kids, leaves, saved


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): the turns of each conversation in order, places from 1.

    Turns are ordered by ``turn``, NULL first, and equal ones by their MD5. A NULL role or text is
    empty. Rows without a conv_id belong to no conversation and are left out; other columns are
    ignored. Texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return narrow.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "bytes")


def with_lent_openings(turns: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """``turns`` with the opening of every conversation replaced by that of its group's first one.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % group`` (all it has if fewer, none
    if there is no such conversation), then its own after its first ``h``, where ``h`` is the CRC-32
    of its decimal id modulo ``longest``. A row of place 0 without a digest stands for each
    conversation, so one that is left without turns is not lost.
    """
    taken = (F.crc32(F.col("conv_id").cast("string")) % longest).alias("taken")
    ids = turns.filter("place = 1").select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % group).alias("lender"))
    lent = turns.filter(F.col("place") < longest).select(F.col("conv_id").alias("lender"), "place", "digest", "bytes")
    opening = lent.join(ids, "lender").filter("place <= taken").select("conv_id", "place", "digest", "bytes")
    own = turns.filter(F.col("place") > taken)
    marks = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(opening).unionByName(marks)


def hash_chains(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) per conversation: the names of its prefixes, and the bytes of its turns.

    A conversation streams through one task; 24 bytes a turn of it are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, path, sizes = None, bytearray(), []

        def row(rows: list[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "path", "sizes"])

        for batch in batches:
            done = []
            for conv_id, digest, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv_id != current:
                    if current is not None:
                        done.append((current, bytes(path), sizes))
                    current, path, sizes = conv_id, bytearray(), []
                if digest is not None:
                    path += xxhash.xxh3_128_digest(bytes(path[-WIDTH:] or ROOT) + digest)
                    sizes.append(size)
            if done:
                yield row(done)
        if current is not None:
            yield row([(current, bytes(path), sizes)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest", "bytes")
    return ordered.mapInArrow(run, "conv_id long, path binary, sizes array<long>")


def ends_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(digest, ends_sha256): the SHA-256 of the ascending ids of the conversations of each end.

    ``ends`` has (digest, conv_id). Ids are sorted by ranges and joined to strings there; only the
    strings, one row in ``IDS_A_CHUNK`` ids, of one end meet in a task, which hashes them as they come.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for d, i in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if ids and (d != digest or len(ids) == IDS_A_CHUNK):
                    out.append((digest, ids[0], ",".join(map(str, ids))))
                    ids = []
                digest = d
                ids.append(i)
            if out:
                yield _chunks(out)
                out = []
        if ids:
            yield _chunks([(digest, ids[0], ",".join(map(str, ids)))])

    def digest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for d, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if d != digest:
                    if digest is not None:
                        done.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield pa.record_batch([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done])], names=["digest", "ends_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([digest], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    ranged = ends.repartitionByRange(parts, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    strings = ranged.select("digest", "conv_id").mapInArrow(join, "digest binary, first_id long, ids string")
    dealt = strings.repartition("digest").sortWithinPartitions("digest", "first_id").select("digest", "ids")
    return dealt.mapInArrow(digest_of, "digest binary, ends_sha256 string")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "first_id", "ids"])


def trie_nodes(turns: DataFrame) -> DataFrame:
    """One row of ``RESULT`` for each node of the prefix trie of all conversations.

    ``turns`` has (conv_id, place, digest, bytes), the places of a conversation ascending and none
    repeated; a row without a digest is no turn. A node is a distinct sequence of first turns; its
    members are the conversations that begin with it, and the root is what all begin with.
    ``saved_tokens`` adds over the subtree what storing each node's last turn once saves. No
    conversations give no nodes.
    """
    spark = turns.sparkSession
    chains = persist_reliably(hash_chains(turns))
    paths = persist_reliably(chains.groupBy("path", "sizes").agg(F.min("conv_id").alias("least"), F.count("*").alias("members")))
    total = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_TURNS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        found: list[tuple] = []
        for row in expanded_nodes(rows, TaskContext.get().partitionId()):
            found.append(row)
            if len(found) == 10_000:
                yield _node_batch(found)
                found = []
        yield _node_batch(found)

    ranged = paths.select("path", "sizes", "least", "members").repartitionByRange(parts, "path")
    nodes = persist_reliably(ranged.mapInArrow(build, _NODES))
    opened, closed = nodes.filter("open"), nodes.filter("NOT open")

    # Open nodes: merged over ranges by their name.
    number = F.col("part") * 2
    merged = persist_reliably(
        opened.groupBy("digest", "parent", "depth", "bytes").agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("kids"),
            F.sum("n_leaves").alias("kid_leaves"),
            F.sum("saved_tokens").alias("kid_saved"),
            F.min(F.when(F.col("lower"), number).otherwise(number + 1)).alias("owner"),
        )
    )
    open_kids = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("open_kids"))
    counted = merged.join(open_kids, "digest", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0)))
    own = counted.select(
        "digest",
        "owner",
        (F.col("kid_leaves") + (F.col("n_children") == 0).cast("long")).alias("own_leaves"),
        (F.col("kid_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"),
    )
    # Every open node adds to its ancestors on one of the border paths it lies on.
    on_paths = opened.select(
        "digest", "depth", F.explode(F.array_compact(F.array(F.when(F.col("lower"), number), F.when(F.col("upper"), number + 1)))).alias("border")
    )
    below = Window.partitionBy("border").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (F.col("owner") == F.col("border")).cast("long")
    subtree = (
        on_paths.join(own, "digest")
        .select("digest", F.sum(counts * F.col("own_leaves")).over(below).alias("l"), F.sum(counts * F.col("own_saved")).over(below).alias("s"))
        .groupBy("digest")
        .agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    )
    known = merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("known_id"))
    columns = ["digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = counted.join(subtree, "digest").join(known, "parent", "left").withColumnRenamed("known_id", "parent_conv_id").select(columns)

    # Complete nodes below an open one: by range, so that no task gets all children of one node.
    in_range = opened.select("part", F.col("digest").alias("parent")).join(known, "parent")
    both = closed.join(in_range, ["part", "parent"], "left")
    whole = both.withColumn("parent_conv_id", F.coalesce("known_id", "parent_conv_id")).select(columns)

    ends = chains.select(F.coalesce(F.expr(f"nullif(substring(path, -{WIDTH}, {WIDTH}), X'')"), F.lit(ROOT)).alias("digest"), "conv_id")
    named = whole.unionByName(tops).join(ends_digests(ends, parts), "digest", "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).select(*(c.split()[0] for c in RESULT.split(", ")))


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}
    fields = [c.split() for c in _NODES.split(", ")]
    columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.record_batch(columns, names=[name for name, _ in fields])
