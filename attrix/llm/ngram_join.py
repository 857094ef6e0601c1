"""Exact n-gram Jaccard self-join by size-aware heavy and light sets.

A document's set holds its distinct word shingles; documents with equal sets
are one node.  Shingles are ordered rare first, by a table of
hashed counters (its size follows the input, within bounds) and then by hash; sets that are similar enough must share
elements among their first few (prefix filter), so only those are posted.

Light sets (up to a size ``x``) enumerate all 2-subsets of a prefix that must
share two elements: a common subset makes a candidate.  Heavy sets scan
inverted lists of single elements, against light sets near ``x`` too.
``x`` is the size with the least estimated cost of enumerating and scanning.

Short lists give pairs with the number of elements they share, summed over
lists; pairs that share too few go: a third of what a similar pair shares
suffices.  The nodes of a long list are not paired.  Any other similar pair shares the rest in long lists, so a node leaves out
its longest lists but for that rest (:func:`_long_share`); nodes that share a few frequent shingles by chance are in none then.
In the lists that stay, nodes meet in groups under the list's smallest node, by size class, and a
group finds its exact links by matrix products.  It returns how many links each
node has there and, for the components, a spanning forest.  Groups are cut into
blocks by sets and bytes, so no task holds more than two blocks.  Elements whose counter stands
well above the others (:func:`hot_level`) may have lists of any length: those are dealt by
node, not by element, and only their smallest node is looked for per element.  Every similar pair is checked
exactly, and counted once: in the smallest of the groups that both nodes belong
to, or as a pair of short lists if there is none.

Texts are scanned three times and never shuffled: for sets and counters, for
prefixes, and for the whole sets of candidates only; these are stored once, bucketed
by node, so joins by node don't shuffle them, and shuffle files go when a step is written.  What is broadcast has a
bounded size: the counters' levels (1 to 16 MB) and a Bloom filter of candidates
(2 MB), which only saves work, as a join by node follows.

Shingle hashes and set digests have 64 bits; equal hashes count as equal.

Edge cases: texts without words have empty sets and link with nothing; with
fewer words than ``n``, the whole sequence is the one shingle; documents with
a null id link with nothing and get a null component; rows that repeat are
copies of one node and link once an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from attrix.llm.common import shared_table
from attrix.llm.word_hashes import mixed, run_starts, word_hashes
from attrix.session import BucketedTable, brief_shuffles, table_bytes

SHINGLE = 4
PERCENT = 85
CELLS = 1 << 20
MOST_CELLS = 1 << 24
CELL_BYTES = 1 << 18  # of the input for each cell, between the two bounds
BLOOM_BITS = 1 << 24
SHORT_LIST = 16
BLOCK = 1000
BLOCK_BYTES = 8 << 20
HOT_SETS = 65_536
BUCKET_ENTRIES = 1 << 19
SCAN_COST = 4.0
LEVELS = 10  # a counter that doubles rises ten levels
# Odd multipliers that tell the words of a shingle apart (fixed values).
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------- sets
def shingle_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles, A-Z lower-cased."""
    words = word_hashes(text.translate(_LOWER) if text else None)
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total += words[k:len(words) - size + 1 + k] * np.uint64(PLACES[k % len(PLACES)] + 2 * (k // len(PLACES)))
    return np.unique(mixed(total))


def node_of(elements: np.ndarray) -> int:
    return xxh3_64_intdigest(elements.tobytes()) >> 1


def least_overlap(size, percent: int = PERCENT):
    """Elements that a set of this size must share with any similar set."""
    return -(-percent * size // 100)


def prefix_length(size, percent: int = PERCENT):
    """Posted elements: similar sets share at least ``size // 32 + 1`` more than none of them."""
    return np.minimum(size, size - least_overlap(size, percent) + size // 32 + 1)


def _pair_prefix(size, percent: int = PERCENT):
    return np.minimum(size, size - least_overlap(size, percent) + 2)


def _short_share(needed: Column) -> Column:
    """Of the elements that a pair must share, how many make it a candidate by short lists alone."""
    return F.least(needed, F.greatest(F.lit(2), F.ceil(needed / 3)))


def _long_share(size: Column) -> Column:
    """The least number of long lists that a set shares with any similar set that short lists do not give.

    A similar pair shares ``size // 32`` posted elements or more, whichever of the two has this size, and at least one.
    """
    needed = F.greatest(F.lit(1), F.floor(size / 32))
    return needed - _short_share(needed) + 1


def light_limit(sizes: np.ndarray, counts: np.ndarray, percent: int = PERCENT, largest: int = 128) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, over all sets."""
    prefix = _pair_prefix(sizes, percent)
    subsets = counts * prefix * (prefix - 1) / 2
    scans = SCAN_COST * counts * prefix_length(sizes, percent)
    cost = [subsets[sizes <= x].sum() + scans[sizes >= percent * x / 100 if x else sizes > 0].sum()
            for x in range(largest + 1)]
    return int(np.argmin(cost))


def counter_cells(input_bytes: int) -> int:
    """Number of counters, a power of two: it follows the input, from ``CELLS`` to ``MOST_CELLS`` (a 16 MB broadcast)."""
    return min(MOST_CELLS, max(CELLS, 1 << max(0, input_bytes // CELL_BYTES).bit_length()))


def hot_level(counts: np.ndarray) -> int:
    """The level from which an element's list may be hot: a cell well above what most cells hold.

    A cell holds the sets of all its elements.  Beyond four times the mean and ``HOT_SETS`` the
    surplus is an element's own; a list below that bound is no larger than it.
    """
    return int(LEVELS * np.log2(1.0 + HOT_SETS + 4 * float(counts.mean()))) if len(counts) else 255


def _set_rows(batches: Iterator[pa.RecordBatch], n: int, n_cells: int) -> Iterator[pa.RecordBatch]:
    """One row a document, and one row a task with its counters."""
    cells = np.zeros(n_cells, np.uint32)
    shift = np.uint64(65 - n_cells.bit_length())
    names = ["doc_id", "text_hash", "n", "node", "cells"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    seen = False
    for batch in batches:
        sizes, nodes, found = [], [], []
        for text in batch.column(1).to_pylist():
            elements = shingle_set(text, n)
            sizes.append(len(elements))
            nodes.append(node_of(elements) if len(elements) else None)
            found.append(elements)
        if found:
            seen = True
            np.add.at(cells, (np.concatenate(found) >> shift).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, types[2]), pa.array(nodes, types[3]),
             pa.nulls(len(sizes), types[4])], names=names)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, t) for t in types[:4]] + [pa.array([zlib.compress(cells.tobytes(), 1)], types[4])], names=names)


def _counter_levels(parts: DataFrame, n_cells: int, fan: int = 32) -> tuple[np.ndarray, int]:
    """All tasks' counters summed in a tree, as logarithmic levels of one byte; and the level of hot ones."""
    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(n_cells, np.uint64)
        for part in table["cells"].to_pylist():
            values = np.frombuffer(zlib.decompress(part), np.uint8)
            total += values.view(np.uint64 if len(values) == 8 * n_cells else np.uint32)
        return pa.table({"cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    left = parts.count()
    while left > 1:
        groups = -(-left // fan)
        parts = shared_table(parts.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
                             .groupBy("g").applyInArrow(summed, "cells binary"), "counters")
        left = parts.count()
    rows = parts.collect()
    if not rows:
        return np.zeros(n_cells, np.uint8), 255
    values = np.frombuffer(zlib.decompress(rows[0]["cells"]), np.uint8)
    counts = values.view(np.uint64 if len(values) == 8 * n_cells else np.uint32)
    return np.minimum(255, LEVELS * np.log2(1.0 + counts)).astype(np.uint8), hot_level(counts)


def _cell(elements: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return elements >> np.uint64(65 - len(levels).bit_length())


def _ordered(elements: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Elements in the global order: by the level of their counter, then by hash."""
    level = levels[_cell(elements, levels)].astype(np.uint64)
    return elements[np.argsort((level << np.uint64(56)) | (elements >> np.uint64(8)), kind="stable")]


def _postings(elements: np.ndarray, levels: np.ndarray, limit: int, percent: int,
              hot_level: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set posts: single elements (even values) and 2-subsets (odd values), and which of them can have hot lists."""
    size = len(elements)
    if 100 * size < percent * (size + 1):
        return np.empty(0, np.uint64), np.empty(0, bool)  # only equal sets are similar
    ordered = _ordered(elements, levels)
    hot = levels[_cell(ordered, levels)] >= hot_level
    out, some = [], []
    if size > limit or 100 * size >= percent * limit or least_overlap(size, percent) <= 1:
        out.append(ordered[:int(prefix_length(size, percent))] & ~np.uint64(1))
        some.append(hot[:len(out[0])])
    if size <= limit:
        first = ordered[:int(_pair_prefix(size, percent))]
        i, j = np.triu_indices(len(first), 1)
        out.append(mixed(first[i] * np.uint64(PLACES[0]) + first[j] * np.uint64(PLACES[1])) | np.uint64(1))
        some.append(hot[i] & hot[j])
    return np.concatenate(out), np.concatenate(some)


# -------------------------------------------------------------------- lists
def _size_class(size: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(size) / -math.log(percent / 100) + 1e-9).astype(np.int64)


MET = "kind int, a long, b long, a_size int, b_size int, shared int"
HOT_LENGTH = 2**31 - 1


def _met(table: pa.Table, limit: int, percent: int) -> pa.Table:
    """Pairs of short lists (kind 0) and the nodes of long ones (kind 1: a is the posting, a_size the class, shared the length).

    A bucket below 0 holds the hot postings of some nodes, whose lists count as long.
    """
    hot = table["bucket"][0].as_py() < 0
    posts, nodes, sizes = [], [], []
    for p, which, n, s in zip(*[table[c].to_pylist() for c in ("posts", "which", "nodes", "sizes")]):
        which = np.frombuffer(which, "<u4")
        posts.append(np.frombuffer(p, "<u8"))
        nodes.append(np.frombuffer(n, "<i8")[which])
        sizes.append(np.frombuffer(s, "<i4")[which])
    posts, nodes, sizes = np.concatenate(posts), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
    order = np.lexsort((nodes, posts))
    posts, nodes, sizes = posts[order], nodes[order], sizes[order]
    once = np.r_[True, (posts[1:] != posts[:-1]) | (nodes[1:] != nodes[:-1])]
    posts, nodes, sizes = posts[once], nodes[once], sizes[once]
    if hot:
        return pa.table({"kind": pa.array(np.ones(len(posts), np.int32), pa.int32()), "a": pa.array(posts.view(np.int64)),
                         "b": pa.array(nodes), "a_size": pa.array(_size_class(sizes, percent), pa.int32()),
                         "b_size": pa.array(sizes, pa.int32()), "shared": pa.array(np.full(len(posts), HOT_LENGTH, np.int32))})
    starts = run_starts(posts)
    lengths = np.diff(np.r_[starts, len(posts)])

    pairs = [np.empty((0, 5), np.int64)]
    for m in range(2, SHORT_LIST + 1):
        at = starts[lengths == m]
        if not len(at):
            continue
        i, j = np.triu_indices(m, 1)
        i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        subset = (posts[i] & np.uint64(1)) > 0
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        # pairs that are similar by one shared element have no 2-subset in common
        fits = (100 * low >= percent * high) & (subset | (high > limit) | (percent * (low + high) <= 100 + percent))
        i, j, subset = i[fits], j[fits], subset[fits]
        pairs.append(np.stack([nodes[i], nodes[j], sizes[i], sizes[j], np.where(subset, 1 << 20, 1)], axis=1))
    pairs = np.concatenate(pairs)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    first = np.flatnonzero(np.r_[True, (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1])][:len(pairs)])
    shared = np.minimum(np.add.reduceat(pairs[:, 4], first), 1 << 24) if len(first) else np.empty(0, np.int64)
    pairs = pairs[first]

    long_ = np.repeat(lengths > SHORT_LIST, lengths)
    member, size, length = nodes[long_], sizes[long_], np.minimum(np.repeat(lengths, lengths)[long_], HOT_LENGTH)
    return pa.table({
        "kind": pa.array(np.r_[np.zeros(len(pairs), np.int32), np.ones(len(member), np.int32)], pa.int32()),
        "a": pa.array(np.r_[pairs[:, 0], posts[long_].view(np.int64)]), "b": pa.array(np.r_[pairs[:, 1], member]),
        "a_size": pa.array(np.r_[pairs[:, 2], _size_class(size, percent)], pa.int32()),
        "b_size": pa.array(np.r_[pairs[:, 3], size], pa.int32()),
        "shared": pa.array(np.r_[shared, length], pa.int32())})


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common values of any two sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    used = counts[inverse] > 1
    owner, column = np.repeat(np.arange(len(sets)), sizes)[used], column[inverse[used]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    return common.astype(np.int32)


LINKED = "a long, b long, n long"


def _group_links(table: pa.Table, percent: int) -> pa.Table:
    """Of the similar pairs among a group's sets: a spanning forest (a, b, null) and the links counted here (a, null, n)."""
    nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
    blobs, places = table["elements"], table["groups"]
    sets = [np.frombuffer(blobs[int(k)].as_py(), "<u8") for k in first]
    sizes = np.array([len(s) for s in sets], np.int32)
    shared = _common(sets)
    del sets
    similar = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    label = np.arange(len(nodes), dtype=np.int32)
    while True:
        lowest = np.where(similar, label[None, :], np.int32(len(nodes))).min(axis=1)
        lowest = np.minimum(label, lowest)[np.minimum(label, lowest)]
        if (lowest == label).all():
            break
        label = lowest
    joined = label != np.arange(len(nodes))

    own, copies = table["own"].to_numpy()[first], table["copies"].to_numpy()[first].astype(float)
    here = table["group"][0].as_py()
    smaller = [np.array([g for g in places[int(k)].as_py() if g < here], np.int64) for k in first]
    counted = similar & (_common(smaller) == 0)
    if table["i"][0].as_py() != table["j"][0].as_py():
        counted &= own[:, None] != own[None, :]
    np.fill_diagonal(counted, False)
    links = (counted @ copies).astype(np.int64)
    some = links > 0
    return pa.table({"a": pa.array(np.r_[nodes[joined], nodes[some]], pa.int64()),
                     "b": pa.array([*nodes[label[joined]].tolist(), *[None] * int(some.sum())], pa.int64()),
                     "n": pa.array([*[None] * int(joined.sum()), *links[some].tolist()], pa.int64())})


# --------------------------------------------------------------- components
def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating stars."""
    edges = shared_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.filter("v > u").join(lowest, F.col("u") == F.col("c"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = shared_table(large, "large-star")
        lowest = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (large.join(lowest, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = shared_table(small, "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


# --------------------------------------------------------------------- join
def _bloom_bits(ids: np.ndarray) -> np.ndarray:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    return np.stack([(h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1) for s in (0, 20, 40)])


def _bloom(ids: DataFrame, fan: int = 16) -> np.ndarray:
    """A Bloom filter of the ids, built by the tasks; the driver joins a fixed number of bitmaps."""
    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            bits[_bloom_bits(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in ids.coalesce(fan).mapInArrow(bitmap, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def similar_documents(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (the number of similar documents), and, to tell
    texts of one id apart, text_hash (xxhash64) and component (a name of its own for each component)."""
    with brief_shuffles(docs.sparkSession):
        return _linked(docs, n, percent, id_col, text_col)


def _linked(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                        F.xxhash64(F.col(text_col)).alias("text_hash"))
    n_cells = counter_cells(table_bytes(docs))
    parts = shared_table(texts.mapInArrow(lambda batches: _set_rows(batches, n, n_cells),
                                           "doc_id long, text_hash long, n int, node long, cells binary"), "shingle-sets")
    sets = parts.filter(F.col("cells").isNull()).drop("cells")
    linkable = sets.filter("node is not null and doc_id is not null")
    counted, hot_from = _counter_levels(parts.filter(F.col("cells").isNotNull()).select("cells"), n_cells)
    levels = spark.sparkContext.broadcast(counted)

    # sizes up to the largest light one, and the sum of all postings
    posted = F.col("n") - F.ceil(F.col("n") * percent / 100) + F.floor(F.col("n") / 32) + 1
    histogram = linkable.filter("n <= 128").groupBy("n").count().collect()
    limit = light_limit(np.array([r["n"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], float),
                        percent)
    total = linkable.agg(F.sum(posted)).first()[0] or 0
    bits = max(0, int(total // BUCKET_ENTRIES).bit_length())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, posts, hot = {}, [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements = shingle_set(text, n)
                if doc is None or not len(elements) or (node := node_of(elements)) in nodes:
                    continue
                nodes[node] = len(nodes)
                sizes.append(len(elements))
                own, some = _postings(elements, levels.value, limit, percent, hot_from)
                posts.append(own)
                hot.append(some)
            if not posts:
                continue
            which = np.repeat(np.arange(len(posts)), [len(p) for p in posts])
            posts, hot = np.concatenate(posts), np.concatenate(hot)
            names, sizes = np.array(list(nodes), np.int64), np.array(sizes, np.int32)
            bucket = (posts >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(posts), np.int64)
            bucket[hot] = -1 - (names[which[hot]] >> (63 - bits))  # a node has 63 bits
            order = np.argsort(bucket, kind="stable")
            starts = run_starts(bucket[order])
            out = []
            for rows in np.split(order, starts[1:]) if len(order) else []:
                own, local = np.unique(which[rows], return_inverse=True)
                out.append((int(bucket[rows[0]]), posts[rows].astype("<u8").tobytes(), local.astype("<u4").tobytes(),
                            names[own].astype("<i8").tobytes(), sizes[own].astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 4)],
                    names=["bucket", "posts", "which", "nodes", "sizes"])

    posts = texts.mapInArrow(post, "bucket int, posts binary, which binary, nodes binary, sizes binary")
    met = shared_table(posts.groupBy("bucket").applyInArrow(lambda t: _met(t, limit, percent), MET), "met")

    a, b = F.col("a_size"), F.col("b_size")
    overlap = F.ceil(percent * (a + b) / (100 + percent))
    def beyond(size: Column) -> Column:
        return F.ceil(size * percent / 100) - F.floor(size / 32) - 1
    pairs = (met.filter("kind = 0").groupBy("a", "b", "a_size", "b_size").agg(F.sum("shared").alias("shared"))
             .filter(F.col("shared") >= _short_share(overlap - F.greatest(beyond(a), beyond(b)))).select("a", "b"))
    pairs = shared_table(pairs, "pairs")
    # of its long lists of single elements a node leaves out as many of the longest as keep it in one with each similar node
    longest = Window.partitionBy("b").orderBy(F.col("shared").desc(), F.col("a").desc())
    single = F.col("a").bitwiseAND(1) == 0
    scanned = met.filter("kind = 1").select("a", "b", "a_size", "b_size", "shared")
    kept = (scanned.filter(single).withColumn("place", F.row_number().over(longest)).filter(F.col("place") >= _long_share(b))
            .drop("place").unionByName(scanned.filter(~single)))
    kept = shared_table(kept.drop("shared"), "scanned")
    leaders = kept.groupBy("a").agg(F.min("b").alias("leader"), F.count(F.lit(1)).alias("length")).filter("length > 1").drop("length")
    # a group is named by a hash of its leader and class; a class meets the next one, as similar sizes are at most one class apart
    members = shared_table(
        kept.join(leaders, "a").select("leader", F.explode(F.array("a_size", F.col("a_size") + 1)).alias("class"), "b", "b_size")
        .select(F.xxhash64("leader", "class").alias("group"), F.col("b").alias("node"), F.col("b_size").alias("size")).distinct(), "members")
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(8 * F.col("sizes") / BLOCK_BYTES)).cast("int")
    groups = shared_table(members.groupBy("group").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("sizes"))
                          .filter("count > 1").select("group", blocks.alias("blocks")), "groups")
    members = members.join(groups, "group")

    places = members.groupBy("node").agg(F.collect_list("group").alias("groups"))
    wanted = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
              .join(places, "node", "full").withColumn("groups", F.coalesce("groups", F.array().cast("array<long>"))))
    reps = linkable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    reps = shared_table(reps, "distinct-sets")
    wanted = shared_table(reps.join(wanted, "node"), "candidates")
    bloom = spark.sparkContext.broadcast(_bloom(wanted.select("rep")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            at = _bloom_bits(ids)
            hit = ((bloom.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
            out = [(int(ids[k]), node_of(e), e.astype("<u8").tobytes()) for k in np.flatnonzero(hit)
                   if len(e := shingle_set(batch.column(1)[int(k)].as_py(), n))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary()])],
                                                 names=["rep", "node", "elements"])

    # dealt by node alone, as the files are, so that no later step shuffles whole sets by node
    own = (F.col("rep") >= F.col("least")) & (F.col("rep") <= F.col("least"))
    stored = BucketedTable(spark, "candidate-sets", "node")
    stored.add(texts.mapInArrow(whole, "rep long, node long, elements binary")
               .join(wanted.withColumnRenamed("rep", "least").hint("merge"), "node").filter(own)
               .select("node", "elements", "copies", "groups"))
    elements = stored.last_rows()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(5), batch.column(6)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(keep, pa.bool_()))

    one = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"), F.col("copies").alias("a_copies"),
                          F.col("groups").alias("a_groups"))
    other = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"), F.col("copies").alias("b_copies"),
                            F.col("groups").alias("b_groups"))
    apart = ~F.arrays_overlap("a_groups", "b_groups")  # else the pair is counted in a group
    pair_links = (pairs.join(other, "b").join(one, "a").select("a", "b", "a_copies", "b_copies", apart.alias("apart"), "x", "y")
                  .mapInArrow(verified, "a long, b long, a_copies long, b_copies long, apart boolean").distinct())
    pair_links = shared_table(pair_links, "pair-links")

    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (members.withColumn("own", block)
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "own"))
    group_links = shared_table(dealt.join(elements, "node").groupBy("group", "i", "j")
                               .applyInArrow(lambda t: _group_links(t, percent), LINKED), "group-links")

    links = pair_links.select("a", "b").unionByName(group_links.filter("n is null").select("a", "b"))
    roots = connected(links)
    named = reps.join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    named = shared_table(named, "nodes")
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    counted = pair_links.filter("apart")
    degree = (counted.select(F.col("a").alias("node"), F.col("b_copies").alias("n"))
              .unionByName(counted.select(F.col("b").alias("node"), F.col("a_copies").alias("n")))
              .unionByName(group_links.filter("n is not null").select(F.col("a").alias("node"), "n"))
              .groupBy("node").agg(F.sum("n").alias("others")))
    n_links = (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    classes = shared_table(named.join(lowest, "root").join(degree, "node", "left").select(
        "node", "component_id", n_links, F.col("root").alias("component")), "components")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sets.join(classes, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), "text_hash",
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
