"""Document fingerprints by MinHash.

A text's shingles are hashed once; ``PERMUTATIONS`` universal hash functions
``a * x + b (mod 2**32)`` with odd ``a`` permute the hashes, and the signature keeps the
least value under each. The share of equal places of two signatures estimates the Jaccard
similarity of their shingle sets. A signature is stored as one hex string, four digits
per place: the lower 16 bits, since the upper ones of a least value are mostly zero. Two
different shingles agree in a place by chance once in 65,536 times.

``near_duplicates`` joins bands of signatures in Spark and verifies the exact Jaccard
similarity of the shingle sets of what collides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from reviewlake.llm.components import connected_components
from reviewlake.llm.simhash import MAX_BROADCAST_ROWS, shuffle_files_removed
from reviewlake.llm.token_ids import SPACES
from reviewlake.llm.text_arrays import groups, mix, shingle_hashes, word_hashes
from reviewlake.session import broadcast_if_bounded, persist_reliably

SHINGLE_WORDS = 5
THRESHOLD = 0.8
PERMUTATIONS = 128
BANDS = 32
#: Each place of a signature is this many hex digits, or half as many bytes.
DIGITS = 4
#: Signatures this much less alike than the threshold are not compared further: at 0.8 and
#: 128 places that is 5.6 standard deviations.
MARGIN = 0.2
#: A larger bucket is compared in blocks of about this many rows, a pair of blocks at a time.
BLOCK_ROWS = 2048
#: Shingle sets of a group hold about twice this many shingles, of 8 bytes each, or are one text's.
BLOCK_SHINGLES = 1 << 22
#: Shingles that are permuted at a time, so that the table stays in the processor's cache.
CHUNK = 1024


def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64)).astype(np.uint32)
    return values[:permutations] | np.uint32(1), values[permutations:]


#: Words are runs without white space; NUL separates texts.
_WORD = np.ones(0x110000, dtype=bool)
_WORD[[0, *SPACES]] = False


def signatures(texts: list[str], n: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of 32-bit least values per text; all ones for a text without words."""
    words, offsets = word_hashes(texts, _WORD)
    hashes, offsets = shingle_hashes(words, offsets, n)
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(texts), permutations), 0xFFFFFFFF, dtype=np.uint32)
    a, b = (x[:, None] for x in _factors(permutations))
    for least, begin, end in zip(out, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at in range(begin, end, CHUNK):
            permuted = values[None, at : min(at + CHUNK, end)] * a
            permuted += b
            np.minimum(least, permuted.min(axis=1), out=least)
    return out


def packed(signature: np.ndarray) -> list[bytes]:
    """The lower 16 bits of each place."""
    return [row.tobytes() for row in signature.astype(np.uint16).astype(">u2")]


def written(signature: np.ndarray) -> list[str]:
    """The lower 16 bits of each place as hex."""
    return [row.hex() for row in packed(signature)]


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal places of the stored parts of signatures, row by row."""
    return (one.astype(np.uint16) == other.astype(np.uint16)).mean(axis=1)


def similarity(one, other, permutations: int = PERMUTATIONS):
    """The same as a column expression over two stored fingerprints."""
    places = F.sequence(F.lit(0), F.lit(permutations - 1))
    equal = F.filter(
        places, lambda k: F.substring(one, k * DIGITS + 1, DIGITS) == F.substring(other, k * DIGITS + 1, DIGITS)
    )
    return F.size(equal) / F.lit(float(permutations))


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; NULL is empty.

    Shingles are ``n`` words between white space, as they are written; fewer words are one
    shingle. Texts without words have the fingerprint of no shingles, all ``f``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [x for lo, hi in groups(texts) for x in written(signatures(texts[lo:hi], n, permutations))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.string())], names=["doc_id", "fingerprint"])

    return _texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def near_duplicates(
    docs: DataFrame,
    n: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, class_id, component_id): documents linked by a Jaccard similarity of ``threshold``.

    Rows with one text are a class, named by its smallest doc_id, and stand for one node
    however many they are. Classes that agree in a band are candidates; a pair is linked
    when the exact similarity of its shingle sets reaches ``threshold``. Each class is
    first compared, in each band, with the smallest one there and with the smallest one that
    agrees in the next band too, which joins most groups. What a band still holds apart is then
    compared throughout: all its pairs of different components, of which those with like
    signatures are verified where they meet. ``component_id`` is the smallest doc_id reachable.

    NULL texts are empty, and texts without words are linked to their copies only. A
    doc_id is one node, even if its rows differ; texts of which no row has a doc_id have
    neither class nor component. Other columns are ignored; no rows give no rows.
    """
    classes = text_classes(docs, n, threshold, bands, block_rows)
    return _texts(docs).select("doc_id", text_digest().alias("digest")).join(classes.drop("n_docs"), "digest").drop("digest")


def text_digest() -> Column:
    """The 16 bytes that stand for a text in joins."""
    return F.unhex(F.md5("text"))


def text_classes(
    docs: DataFrame,
    n: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    block_rows: int = BLOCK_ROWS,
    rows: DataFrame | None = None,
) -> DataFrame:
    """(digest, n_docs, class_id, component_id) of each different text, as :func:`near_duplicates` says.

    Texts are not shuffled: signatures are made where the rows are, and shingle sets only of
    texts whose signatures are like another's. Only bands that hold several classes are stored.
    ``rows`` is a stored (doc_id, digest, fingerprint) of all rows of ``docs`` with shingles of
    ``n`` words and the places of a fingerprint as bytes; with it no text is signed again.
    """
    spark = docs.sparkSession
    with shuffle_files_removed(spark):
        rows = persist_reliably(_signed(docs, n)) if rows is None else rows
        # Rows of one digest have one text, and so one fingerprint.
        classes = persist_reliably(
            rows.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("class_id"), F.min("fingerprint").alias("fingerprint"))
        )
        signed = classes.drop("n_docs")
        crowded = _crowded(signed, bands)
        links = _verified(_alike(_beside(crowded), signed, threshold - MARGIN), signed, docs, n, threshold)
        roots = connected_components(links).withColumnRenamed("node", "class_id")
        named = crowded.join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        named = persist_reliably(named.select("class_id", "root", "k", "part"))
        apart = named.join(_mixed(named, block_rows), ["k", "part"]).join(signed.select("class_id", "fingerprint"), "class_id")
        late = _late_links(persist_reliably(apart), signed, docs, n, threshold, block_rows, bands)
        out = classes.drop("fingerprint").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        if not late.isEmpty():
            # Late links join roots, so only they are joined anew.
            further = connected_components(late).select(F.col("node").alias("root"), F.col("root").alias("last"))
            out = out.join(further, "root", "left").withColumn("root", F.coalesce("last", "root"))
        return persist_reliably(out.select("digest", "n_docs", "class_id", F.col("root").alias("component_id")))


def with_classes(rows: DataFrame, digest: str, classes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ..., ``digest``) with class_id and component_id in place of ``digest``.

    A text that is alone is its own class and component, so only the others are joined.
    """
    grouped = persist_reliably(classes.filter("n_docs > 1 OR component_id != class_id").drop("n_docs"))
    named = broadcast_if_bounded(grouped.withColumnRenamed("digest", digest), MAX_BROADCAST_ROWS)
    filled = {c: F.coalesce(c, "doc_id") for c in ("class_id", "component_id")}
    return rows.join(named, digest, "left").withColumns(filled).drop(digest)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, fingerprint) of each row, the places of a fingerprint as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [x for lo, hi in groups(texts) for x in packed(signatures(texts[lo:hi], n))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "digest", "fingerprint"])

    texts = _texts(docs).select("doc_id", text_digest().alias("digest"), "text")
    return texts.mapInArrow(run, "doc_id long, digest binary, fingerprint binary")


def _crowded(signed: DataFrame, bands: int) -> DataFrame:
    """(class_id, k, part, finer, first): the rows of bands that several classes share, stored.

    ``finer`` stands for the parts of this band and the next, ``first`` is the smallest class of the
    band. Bands are counted by a hash; rows that only the hash joins are candidates in vain.
    """
    width = PERMUTATIONS // bands * DIGITS // 2
    following = F.substring(_places(signed), (F.col("k") + 1) % bands * width + 1, F.lit(width))
    bucket, finer = F.xxhash64("k", "part").alias("bucket"), F.xxhash64("k", "part", following).alias("finer")
    banded = _banded(signed, bands).select("class_id", "k", "part", bucket, finer)
    ends = banded.groupBy("bucket").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last"))
    shared = persist_reliably(ends.filter("first < last").select("bucket", "first"))
    return persist_reliably(banded.join(shared, "bucket").drop("bucket"))


def _beside(crowded: DataFrame) -> DataFrame:
    """(node, other): each class with the first of its band and with the first that shares the next band too."""
    nearer = crowded.groupBy("finer").agg(F.min("class_id").alias("nearest"))
    both = crowded.join(nearer, "finer").select("class_id", F.explode(F.array("first", "nearest")).alias("other"))
    pairs = both.filter("other != class_id").select(F.greatest("class_id", "other").alias("node"), F.least("class_id", "other").alias("other"))
    # Dealt by node, repeats meet and so do the signatures that are joined next.
    return pairs.repartition("node").distinct()


def _alike(pairs: DataFrame, signed: DataFrame, alike: float) -> DataFrame:
    """The pairs whose signatures are equal in a share ``alike`` of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_table(batch.column(k)) for k in (2, 3))
            like = pa.array((a == b).mean(axis=1) >= alike)
            yield batch.select(["node", "other"]).filter(like)

    left = signed.select(F.col("class_id").alias("node"), _places(signed).alias("a"))
    right = signed.select(F.col("class_id").alias("other"), _places(signed).alias("b"))
    both = pairs.join(left, "node").join(right, "other").select("node", "other", "a", "b")
    return both.mapInArrow(run, "node long, other long").distinct()


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (node, other) whose shingle sets have a Jaccard similarity of ``threshold``, stored."""
    pairs = persist_reliably(pairs)
    named = pairs.select(F.col("node").alias("class_id")).unionAll(pairs.select("other")).distinct()
    shingled = _shingled(named, signed, docs, n)
    left = shingled.select(F.col("doc_id").alias("node"), F.col("shingles").alias("a"))
    right = shingled.select(F.col("doc_id").alias("other"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    whole = F.size("a") + F.size("b") - shared
    both = pairs.join(left, "node").join(right, "other")
    return persist_reliably(both.filter((whole > 0) & (shared >= threshold * whole)).select("node", "other"))


def _shingled(named: DataFrame, signed: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) of the named classes, from one row of each text, stored."""
    wanted = persist_reliably(signed.select("class_id", "digest").join(named, "class_id"))
    listed = broadcast_if_bounded(wanted.select(F.col("class_id").alias("doc_id"), "digest"), MAX_BROADCAST_ROWS)
    texts = _texts(docs).withColumn("digest", text_digest()).join(listed, ["doc_id", "digest"])
    sets = shingle_sets(texts, n).withColumn("hash", F.xxhash64("shingles"))
    once = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy(F.size("shingles")))
    return persist_reliably(sets.withColumn("_rank", once).filter("_rank = 1").select("doc_id", "shingles"))


def _places(signed: DataFrame) -> Column:
    """The places of the fingerprints as bytes, which may be stored as hex."""
    stored = isinstance(signed.schema["fingerprint"].dataType, BinaryType)
    return F.col("fingerprint") if stored else F.unhex("fingerprint")


def _table(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row per fingerprint, one column per place."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), PERMUTATIONS)


def _banded(signed: DataFrame, bands: int) -> DataFrame:
    """(class_id, fingerprint, k, part): one row per band; classes without words or id have none."""
    width = PERMUTATIONS // bands * DIGITS // 2
    places = _places(signed)
    parts = [
        F.struct(F.lit(k).alias("k"), F.substring(places, k * width + 1, width).alias("part"))
        for k in range(bands)
    ]
    no_words = F.lit(b"\xff" * (PERMUTATIONS * DIGITS // 2))
    some = signed.filter((places != no_words) & F.col("class_id").isNotNull())
    return some.select("class_id", "fingerprint", F.inline(F.array(*parts)))


def _late_links(apart: DataFrame, signed: DataFrame, docs: DataFrame, n: int, threshold: float, block_rows: int, bands: int) -> DataFrame:
    """(node, other): links between the roots of the bands of the stored ``apart``, stored.

    Where many texts are alike but below the threshold, pairs to verify grow with the square of
    their number. So pairs are not rows: a row that is in any pair takes its shingle set to its band,
    and the group of rows is verified in numpy. Of each group only links that join two roots leave,
    as links of these roots.
    """
    some = _rows_apart(apart, threshold - MARGIN, block_rows, bands)
    some = persist_reliably(some.groupBy("class_id").agg(F.collect_set("k").alias("ks")))
    sets = _shingled(some.select("class_id"), signed, docs, n).withColumnRenamed("doc_id", "class_id")
    apart = apart.drop("blocks").join(some, "class_id").filter(F.array_contains("ks", F.col("k").cast("long"))).drop("ks")
    sized = apart.select("class_id", "k", "part", "root").join(sets.select("class_id", F.size("shingles").alias("n")), "class_id")
    rows = apart.join(_mixed(sized, block_rows), ["k", "part"]).join(sets, "class_id")
    return persist_reliably(_links_apart(rows, threshold, block_rows, bands))


def _mixed(banded: DataFrame, block_rows: int) -> DataFrame:
    """(k, part, blocks): the bands of several roots, and into how many blocks each is cut."""
    blocks = F.ceil(F.count("*") / block_rows)
    if "n" in banded.columns:
        blocks = F.greatest(blocks, F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = banded.groupBy("k", "part").agg(blocks.alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most"))
    return sizes.filter("least < most").select("k", "part", "blocks")


def _pairs_apart(banded: DataFrame, alike: float, block_rows: int, bands: int = BANDS) -> DataFrame:
    """(node, other): classes of one band and different roots whose signatures are alike, once each."""

    def pairs(group: pa.Table, found: Found, root: np.ndarray) -> pa.RecordBatch:
        node = group["class_id"].to_numpy()
        named = [np.stack([np.maximum(node[i], node[others]), np.minimum(node[i], node[others])]) for i, others in found]
        one, two = np.concatenate([np.zeros((2, 0), dtype=np.int64), *named], axis=1)
        return pa.record_batch([pa.array(one), pa.array(two)], names=["node", "other"])

    return _apart(banded, alike, block_rows, bands, pairs, "node long, other long").distinct()


def _rows_apart(banded: DataFrame, alike: float, block_rows: int, bands: int = BANDS) -> DataFrame:
    """(k, part, class_id): the rows of bands that are in one of the pairs of :func:`_pairs_apart`, for each group of them."""

    def members(group: pa.Table, found: Found, root: np.ndarray) -> pa.RecordBatch:
        paired = np.zeros(len(root), dtype=bool)
        for i, others in found:
            paired[i] |= len(others) > 0
            paired[others] = True
        return group.select(["k", "part", "class_id"]).filter(pa.array(paired)).combine_chunks().to_batches()

    return _apart(banded, alike, block_rows, bands, members, "k long, part binary, class_id long")


def _links_apart(banded: DataFrame, threshold: float, block_rows: int, bands: int = BANDS) -> DataFrame:
    """(node, other): roots of each band that the pairs of :func:`_pairs_apart` join that reach
    ``threshold``; ``banded`` has the shingles of its rows."""

    def links(group: pa.Table, found: Found, root: np.ndarray) -> pa.RecordBatch:
        first, sets = group["root"].to_numpy(), group["shingles"].combine_chunks()
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        names, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        mine = np.zeros(len(names), dtype=bool)
        named: list[tuple[int, int]] = []
        for i, others in found:
            own = flat[starts[i] : starts[i] + sizes[i]]
            mine[own] = True
            for other in _parts(others, sizes):
                ends = np.cumsum(sizes[other])
                begins = ends - sizes[other]
                hits = mine[flat[np.repeat(starts[other] - begins, sizes[other]) + np.arange(ends[-1])]]
                shared = np.add.reduceat(hits, begins, dtype=np.int64)
                linked = other[shared >= threshold * (sizes[i] + sizes[other] - shared)]
                for at in linked[np.unique(root[linked], return_index=True)[1]].tolist():
                    if root[at] != root[i]:
                        named.append((max(first[i], first[at]), min(first[i], first[at])))
                        root[root == root[at]] = root[i]
            mine[own] = False
        one, two = (pa.array([pair[k] for pair in named], pa.int64()) for k in (0, 1))
        return pa.record_batch([one, two], names=["node", "other"])

    return _apart(banded, threshold - MARGIN, block_rows, bands, links, "node long, other long")


def _parts(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in parts of about ``BLOCK_SHINGLES`` shingles."""
    if len(rows):
        part = np.cumsum(sizes[rows]) // BLOCK_SHINGLES
        yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)


#: A row of a group and the later rows that it makes pairs with.
Found = Iterator[tuple[int, np.ndarray]]


def _apart(
    banded: DataFrame,
    alike: float,
    block_rows: int,
    bands: int,
    emit: Callable[[pa.Table, Found, np.ndarray], pa.RecordBatch | list[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``emit`` makes of each group's pairs of different roots whose signatures are alike.

    Bands that are of one root already take no part. Rows of a large band are dealt to
    blocks, their number as :func:`_mixed` gives it or as ``banded`` has it, and every pair of
    blocks is a group of its own, so that none is larger than two blocks; the rows of a group are compared in numpy.
    A pair is found in the first band that it shares, which holds two roots like all that it
    shares, and in the one group where its blocks meet, so it is found once. ``emit`` gets the roots of
    a group's rows, and pairs that it has brought under one root are not found any more.
    """
    width = PERMUTATIONS // bands
    wide = "shingles" in banded.columns
    if "blocks" not in banded.columns:
        banded = banded.join(_mixed(banded, block_rows), ["k", "part"])
    dealt = banded.withColumn("block", F.pmod(F.xxhash64("class_id"), "blocks"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("k", "part", F.least("block", "with"), F.greatest("block", "with"))
    # Rows of a group of two blocks have their block, those of a block alone have -1.
    side = F.when(F.col("block") == F.col("with"), F.lit(-1)).otherwise(F.col("block")).alias("side")
    rows = met.select(
        group.alias("group"), "class_id", "root", _places(banded).alias("signature"), F.col("k").cast("long").alias("k"), "part", side,
        *(["shingles"] if wide else []),
    )

    def similar(root: np.ndarray, signature: np.ndarray, k: np.ndarray, side: np.ndarray) -> Found:
        for i in range(len(root) - 1):
            met = (root[i + 1 :] != root[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0))
            rest = i + 1 + np.flatnonzero(met)
            equal = signature[rest] == signature[i]
            rest, equal = (x[equal.mean(axis=1) >= alike] for x in (rest, equal))
            before = equal[:, : k[i] * width].reshape(len(rest), k[i], width).all(axis=2).any(axis=1)
            yield i, rest[~before]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
                if held[0]["group"][0] == batch["group"][-1]:
                    continue
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks()
            group = whole["group"].to_numpy()
            starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            ends = np.append(starts[1:], len(group))
            held = []
            if batch is not None:
                held = whole.slice(starts[-1]).to_batches()
                starts, ends = starts[:-1], ends[:-1]
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                own = whole.slice(lo, hi - lo)
                root, k, side = (own[c].to_numpy() for c in ("root", "k", "side"))
                root = root.copy()
                out = emit(own, similar(root, _table(own["signature"]), k, side), root)
                yield from out if isinstance(out, list) else [out]

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles): the different 64-bit shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for lo, hi in groups(texts):
                hashes, offsets = shingle_hashes(*word_hashes(texts[lo:hi], _WORD), n)
                rows += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
