"""Substring deduplication with fixed-block anchors.

A repeat is a run of ``window`` words that also starts in a document with a
smaller id; its later occurrences are removed, judged on the input.

Anchors.  Each document's non-overlapping blocks of ``window // 2`` words are
the index; every rolling window of that length probes it.  A repeat of
``window`` words covers at least one whole block of either document, so only windows
whose own block was hit elsewhere can repeat.  Those are extended to
``window`` words, and each such hash gets the smallest id that has it.  A
window is covered when that id is smaller than its document's; touching
windows merge into maximal spans.

Movement.  Documents are dealt into groups of about ``group_bytes`` of text,
a number that follows the input, and are shuffled once; the three steps read the same
exchange.  A group sends each distinct hash once, packed by hash bucket, so a
passage on a third of all documents is one entry a group, and no pair of
documents is ever built.  What a bucket finds goes back only to the groups
that asked.

Hashes are 64 bits of a polynomial over 64-bit word hashes; anchors are
compared by 38 bits within a bucket (a false anchor only costs work), windows by 63 bits.

Edge cases: null text has no words; a null id is never smaller and is never
trimmed; equal ids are not smaller than each other, so repeated rows are
treated alike; texts shorter than a window are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.word_hashes import mixed, run_starts, word_hashes

WINDOW = 50
GROUP_BYTES = 4 << 20
BUCKET_HASHES = 4 << 20
_KEY_BITS = 38
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


class Rolling:
    """Rolling window hashes over the words of several documents."""

    def __init__(self, texts: list[bytes | None]):
        parts = [word_hashes(t) for t in texts]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        values = np.concatenate([*parts, np.empty(0, np.uint64)])
        self.n = len(values)
        sums = np.cumsum(values * _power(_BASE, self.n), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.lengths)
        self.place = np.arange(self.n, dtype=np.int32) - self.starts.astype(np.int32)[self.doc]
        self.left = self.lengths.astype(np.int32)[self.doc] - self.place

    def at(self, size: int, where: np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start at ``where``."""
        h = (self.sums[where + size] - self.sums[where]) * _power(_INVERSE, self.n)[where]
        return mixed(h)


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes | None], pa.Table]:
    table = table.filter(pc.is_valid(table["doc_id"])).sort_by("doc_id")
    return table["doc_id"].to_numpy(), table["text"].to_pylist(), table


def _bucketed(group: int, hashes: np.ndarray, bits: int, *payload: np.ndarray) -> pa.Table:
    """Sorted hashes and what belongs to them, cut by their top ``bits``."""
    edges = np.searchsorted(hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64),
                            np.arange((1 << bits) + 1, dtype=np.uint64))
    filled = np.flatnonzero(np.diff(edges))
    columns = {"bucket": pa.array(filled, pa.int32()), "g": pa.array(np.full(len(filled), group), pa.int32())}
    for k, values in enumerate(payload):
        columns[f"v{k}"] = pa.array([values[edges[b]:edges[b + 1]].tobytes() for b in filled], pa.binary())
    return pa.table(columns)


def _gathered(table: pa.Table, *types: str) -> tuple[np.ndarray, ...]:
    """The packed entries of a bucket: the row each came from, then its values."""
    out = [np.concatenate([np.frombuffer(b, t) for b in table[f"v{k}"].to_pylist()]) for k, t in enumerate(types)]
    counts = [len(b) // np.dtype(types[0]).itemsize for b in table["v0"].to_pylist()]
    return np.repeat(np.arange(len(counts)), counts), *out


def _sent_back(table: pa.Table, rows: np.ndarray, chosen: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Per group, the chosen entries (rows are in ascending order)."""
    rows = rows[chosen]
    starts = run_starts(rows)
    ends = np.r_[starts[1:], len(rows)] if len(starts) else starts
    groups = table["g"].to_numpy()
    columns = {"g": pa.array(groups[rows[starts]] if len(starts) else [], pa.int32())}
    for k, v in enumerate(values):
        v = v[chosen]
        columns[f"v{k}"] = pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    return pa.table(columns)


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 group_bytes: int = GROUP_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word ranges), kept_text."""
    block = window // 2
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    bits = max(0, int(size // 6 // bucket_hashes).bit_length())  # about six bytes a word
    shift = np.uint64(64 - bits - _KEY_BITS)
    group = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit(b"")))), F.lit(groups)).cast("int")
    dealt = texts.withColumn("g", group).repartition(max(1, groups // 8), "g")

    def probes(key: tuple, table: pa.Table) -> pa.Table:
        """Distinct hashes of every rolling block window: are they in several documents here, are they a block."""
        _, texts, _ = _texts(table)
        rolling = Rolling(texts)
        where = np.flatnonzero((rolling.left >= block) & (rolling.place + rolling.left >= window))
        hashes = rolling.at(block, where)
        order = np.argsort(hashes, kind="stable")
        hashes, where = hashes[order], where[order]
        starts = run_starts(hashes)
        if not len(starts):
            return _bucketed(0, hashes, bits, np.empty(0, "u4"), np.empty(0, "u1"))
        ends = np.r_[starts[1:], len(hashes)] - 1
        several = rolling.doc[where[starts]] != rolling.doc[where[ends]]
        blocks = np.logical_or.reduceat(rolling.place[where] % block == 0, starts)
        keys = (hashes[starts] >> shift) & np.uint64((1 << _KEY_BITS) - 1)
        entry = (keys << np.uint64(2)) | (blocks.astype(np.uint64) << np.uint64(1)) | several.astype(np.uint64)
        return _bucketed(key[0].as_py(), hashes[starts], bits, (entry >> np.uint64(8)).astype("<u4"), entry.astype("u1"))

    def anchored(key: tuple, table: pa.Table) -> pa.Table:
        """Blocks that another document's window equals, back to the groups that own them."""
        rows, high, low = _gathered(table, "<u4", "u1")
        entry = (high.astype(np.uint64) << np.uint64(8)) | low
        keys = entry >> np.uint64(2)
        order = np.argsort(keys, kind="stable")
        starts = run_starts(keys[order])
        counts = np.diff(np.r_[starts, len(keys)])
        flags = np.bitwise_or.reduceat(entry[order], starts)
        hit = np.empty(len(keys), bool)
        hit[order] = np.repeat(((counts > 1) | (flags & np.uint64(1) > 0)) & (flags & np.uint64(2) > 0), counts)
        owned = hit & (entry & np.uint64(2) > 0)
        full = keys | np.uint64(key[0].as_py() << _KEY_BITS)
        return _sent_back(table, rows, np.flatnonzero(owned), full)

    def extended(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """Full windows around anchors, once a hash: the smallest id, and whether several documents here have it."""
        ids, texts, _ = _texts(table) if found.num_rows else ([], [], None)
        rolling = Rolling(texts)
        where = np.flatnonzero(rolling.left >= window) if rolling.n else np.empty(0, np.int64)
        own = where + -rolling.place[where] % block  # the first block within the window
        blocks = np.unique(own)
        if len(blocks):
            anchors = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in found["v0"].to_pylist()]))
            where = where[np.isin(own, blocks[np.isin(rolling.at(block, blocks) >> shift, anchors)])]
        hashes = rolling.at(window, where) >> np.uint64(1) << np.uint64(1)
        order = np.argsort(hashes, kind="stable")
        hashes, where = hashes[order], where[order]
        starts = run_starts(hashes)
        if not len(starts):
            return _bucketed(0, hashes, bits, hashes, np.empty(0, "<i8"))
        first, last = rolling.doc[where[starts]], rolling.doc[where[np.r_[starts[1:], len(hashes)] - 1]]
        several = ids[first] != ids[last]
        return _bucketed(key[0].as_py(), hashes[starts], bits, hashes[starts] | several.astype(np.uint64), ids[first])

    def settled(key: tuple, table: pa.Table) -> pa.Table:
        """The smallest id of each window, to the groups where another document has it."""
        rows, tagged, ids = _gathered(table, "<u8", "<i8")
        hashes = tagged >> np.uint64(1)
        order = np.argsort(hashes, kind="stable")
        starts = run_starts(hashes[order])
        smallest = np.empty(len(ids), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(ids)]))
        return _sent_back(table, rows, np.flatnonzero((tagged & np.uint64(1) > 0) | (smallest < ids)), hashes, smallest)

    def trimmed(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        covered: dict[int, np.ndarray] = {}
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        if found.num_rows:
            known = np.concatenate([np.frombuffer(b, "<u8") for b in found["v0"].to_pylist()])
            smallest = np.concatenate([np.frombuffer(b, "<i8") for b in found["v1"].to_pylist()])
            order = np.argsort(known)
            known, smallest = known[order], smallest[order]
            rolling = Rolling(texts)
            where = np.flatnonzero(rolling.left >= window)
            hashes = rolling.at(window, where) >> np.uint64(1)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids])[rolling.doc[where]]
            where = where[(known[at] == hashes) & (smallest[at] < own)]
            steps = np.zeros(rolling.n + 1, np.int64)
            np.add.at(steps, where, 1)
            np.add.at(steps, where + window, -1)
            mask = np.cumsum(steps[:-1]) > 0
            for d in np.unique(rolling.doc[where]):
                covered[d] = mask[rolling.starts[d]:rolling.starts[d] + rolling.lengths[d]]
        out = []
        for d, (doc_id, text) in enumerate(zip(ids, texts)):
            words, spans, removed = text.split() if text else [], [], 0
            n = len(words)
            if d in covered:
                cut = np.flatnonzero(np.diff(np.r_[False, covered[d], False].astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(cut[::2], cut[1::2])]
                removed = int(covered[d].sum())
                words = [w for w, c in zip(words, covered[d].tolist()) if not c]
            out.append((doc_id, n, removed, spans, b" ".join(words)))
        columns = list(zip(*out)) if out else [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.table(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    per_group = dealt.groupBy("g")
    anchors = (per_group.applyInArrow(probes, "bucket int, g int, v0 binary, v1 binary")
               .groupBy("bucket").applyInArrow(anchored, "g int, v0 binary"))
    smallest = (per_group.cogroup(anchors.groupBy("g")).applyInArrow(extended, "bucket int, g int, v0 binary, v1 binary")
                .groupBy("bucket").applyInArrow(settled, "g int, v0 binary, v1 binary"))
    return per_group.cogroup(smallest.groupBy("g")).applyInArrow(trimmed, RESULT)
