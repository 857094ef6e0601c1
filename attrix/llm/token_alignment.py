"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes.  A token of either side overlaps a stretch of the
other's tokens; overlapping tokens form components, which are the groups between
the offsets where both sides end a token.  Every token points to the farthest-right
token that overlaps it; doubling the pointers (each pointer takes its target's)
leads every token to its component's last token, which labels the group.  All documents of a
block are doubled together in numpy.

A link is a pair of overlapping token occurrences, one of each side.  How often two ids are
linked in the corpus is counted in Spark:

1. Texts are tokenized once, where they are read.  A block of documents (about
   ``block_bytes`` of text) writes one row with its distinct id pairs and their counts,
   and, packed, which pairs each document has.
2. The pairs' counts are summed by pair, and each id of the second side gets
   its highest count.
3. Blocks join their distinct pairs with those figures and sum them by document.

No text is shuffled, a pair is sent once a block, and sums are pre-aggregated,
so a pair that is everywhere costs one row a block; its join partition is one that adaptive execution can split.

Tokenizer A is byte-level BPE.  The same vocabulary in ``tiktoken`` form is used for texts of
common Latin characters, where both libraries cut words alike; other texts
go through the tokenizer file itself.

Edge cases: null and empty texts, and texts that a tokenizer does not give back
byte for byte, have no tokens; null ids and repeated rows are kept, each
row by itself; a text longer than a block is a block of its own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import shared_table
from attrix.llm.word_hashes import run_starts

BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
# Characters that both byte-level libraries classify alike: printable ASCII, tab, line ends, Latin letters.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ſ]*")
BLOCK_SCHEMA = "block long, keys array<long>, counts array<long>, docs binary"
REPORT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")
GROUPS = "doc_id long, groups array<struct<a:array<int>,b:array<int>,start:long,end:long>>"


# -------------------------------------------------------------- tokenizers
class ByteLevel:
    """Byte-level BPE from a tokenizer file; with the same ranks for ``tiktoken`` it is faster on plain texts."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # text is only ever text
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in self.tokens])
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self.fast and PLAIN.fullmatch(text):
                out[k] = self.fast.encode_ordinary(text)
            else:
                slow.append(k)
        for k, e in zip(slow, self.tokenizer.encode_batch([texts[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out


class Pieces:
    """A sentencepiece model that puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.tokens])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tokenizers(NamedTuple):
    """Files of the two tokenizers; the last two only make the first faster."""

    byte_level: str
    pieces: str
    ranks: str | None = None
    pattern: str | None = None


@lru_cache(maxsize=2)
def _loaded(files: Tokenizers) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(files.byte_level, files.ranks, files.pattern), Pieces(files.pieces)


# --------------------------------------------------------------- alignment
class Aligned:
    """Tokens of several texts of two sides, their groups and links; offsets run on from text to text."""

    def __init__(self, a_ids: list[list[int]], b_ids: list[list[int]], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.n_a = np.array([len(x) for x in a_ids], np.int64)
        self.n_b = np.array([len(x) for x in b_ids], np.int64)
        self.a = np.fromiter((i for x in a_ids for i in x), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter((i for x in b_ids for i in x), np.int64, int(self.n_b.sum()))
        self.a_end, self.b_end = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        a_start, b_start = self.a_end - a_lengths[self.a], self.b_end - b_lengths[self.b]
        # pointers: tokens of A first, then those of B; a token whose end both share is reached from B's
        over_a = np.searchsorted(self.b_end, self.a_end)  # B token that holds the last byte of each A token
        over_b = np.searchsorted(self.a_end, self.b_end)
        n = len(self.a)
        last = self.a_end[np.minimum(over_b, n - 1)] == self.b_end if n else np.empty(0, bool)
        self.jump = np.concatenate([n + over_a, np.where(last, n + np.arange(len(self.b)), over_b)])
        while not np.array_equal(further := self.jump[self.jump], self.jump):
            self.jump = further
        ends = np.flatnonzero(last)
        rank = np.cumsum(last) - 1
        self.group_a, self.group_b = rank[self.jump[:n] - n], rank[self.jump[n:] - n]
        self.group_end = self.b_end[ends]
        first = np.searchsorted(self.b_end, a_start, "right")
        width = over_a - first + 1
        self.link_a = np.repeat(np.arange(n), width)
        self.link_b = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + first[self.link_a]
        self.doc_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.doc_b = np.repeat(np.arange(len(self.n_b)), self.n_b)
        self.n_groups = np.bincount(self.doc_b[ends], minlength=len(self.n_b)) if len(ends) else np.zeros(len(self.n_b), np.int64)
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=len(self.n_a))

    def written(self, names: list[bytes], n_b_ids: int) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` has the four forms of every id (see :func:`_names`)."""
        n_a_ids = len(names) // 2 - n_b_ids
        ends_a = np.r_[self.group_a[1:] != self.group_a[:-1], True] if len(self.a) else np.empty(0, bool)
        ends_b = np.r_[self.group_b[1:] != self.group_b[:-1], True] if len(self.b) else np.empty(0, bool)
        # tokens in the order of writing: a group's A tokens, then its B tokens
        order = np.empty(len(self.a) + len(self.b), np.int64)
        b_before = np.searchsorted(self.group_b, self.group_a)
        a_until = np.searchsorted(self.group_a, self.group_b, "right")
        order[np.arange(len(self.a)) + b_before] = self.a + n_a_ids * ends_a
        order[np.arange(len(self.b)) + a_until] = 2 * n_a_ids + self.b + n_b_ids * ends_b
        edges = np.cumsum(np.r_[0, self.n_a + self.n_b]).tolist()
        name = names.__getitem__
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield b"".join(map(name, order[lo:hi].tolist()))[:-1]


def _names(n_a: int, n_b: int) -> list[bytes]:
    """Decimal ids with what follows them: within A's tokens, after the last, within B's, after the last."""
    return [b"%d%s" % (i, after) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for after in marks for i in range(n)]


def align(texts: list[str | None], tokenizers: tuple[ByteLevel, Pieces]) -> Aligned:
    """Tokens and groups of some texts; a text that a side does not give back has no tokens."""
    a, b = tokenizers
    spaced = [" " + t if t else "" for t in texts]
    a_ids, b_ids = a.encode(spaced), b.encode([t or "" for t in texts])
    for k, text in enumerate(spaced):
        raw = text.encode()
        if not text or any(b"".join(map(side.tokens.__getitem__, ids[k])) != raw for side, ids in ((a, a_ids), (b, b_ids))):
            a_ids[k] = b_ids[k] = []
    return Aligned(a_ids, b_ids, a.lengths, b.lengths)


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most about ``size`` bytes, or one text."""
    ids, texts, held = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc)
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def token_groups(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its groups in order (ids of both sides, byte range in space + text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        kind = pa.list_(pa.struct([("a", ints), ("b", ints), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for ids, texts in _chunks(batch, CHUNK_BYTES):
                x = align(texts, _loaded(files))
                a = np.split(x.a, np.flatnonzero(np.diff(x.group_a)) + 1)
                b = np.split(x.b, np.flatnonzero(np.diff(x.group_b)) + 1)
                ends = x.group_end.tolist()
                starts = [0, *ends[:-1]]
                out, at = [], 0
                for n in x.n_groups.tolist():
                    base = starts[at] if n else 0
                    out.append([{"a": a[g], "b": b[g], "start": starts[g] - base, "end": ends[g] - base}
                                for g in range(at, at + n)])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    return _texts(docs, id_col, text_col).mapInArrow(cut, GROUPS)


# ------------------------------------------------------------ corpus counts
class _Block:
    """Documents whose links are packed together: per document its distinct id pairs and how often it has them."""

    def __init__(self):
        self.ids, self.figures, self.digests, self.keys, self.repeats, self.sizes = [], [], [], [], [], []
        self.bytes = 0

    def add(self, ids: list, x: Aligned, digests: list[str], key_base: int) -> None:
        self.ids += ids
        self.digests += digests
        self.figures.append(np.stack([x.n_a, x.n_b, x.n_groups, x.n_links], 1))
        doc = x.doc_a[x.link_a]
        key = x.b[x.link_b] * key_base + x.a[x.link_a]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.empty(0, np.int64)
        self.keys.append(key[starts])
        self.repeats.append(np.diff(np.r_[starts, len(key)]))
        self.sizes.append(np.bincount(doc[starts], minlength=len(ids)))

    def row(self, number: int) -> tuple:
        keys, repeats = np.concatenate(self.keys), np.concatenate(self.repeats)
        distinct, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, weights=repeats, minlength=len(distinct)).astype(np.int64)
        # frequent pairs get small numbers, which pack well
        rank = np.empty(len(distinct), np.int64)
        order = np.argsort(-counts, kind="stable")
        rank[order] = np.arange(len(distinct))
        sizes, figures = np.concatenate(self.sizes), np.concatenate(self.figures)
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "digest": pa.array(self.digests, pa.string()),
                          "size": pa.array(sizes, pa.int64()),
                          **{f"f{k}": pa.array(figures[:, k], pa.int64()) for k in range(4)}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        parts = [bytes(sink.getvalue()), rank[place].astype("<u4").reshape(-1, 1).view("u1").T.tobytes(),
                 repeats.astype("<u4").reshape(-1, 1).view("u1").T.tobytes()]
        pack = zstandard.ZstdCompressor(level=1).compress
        return number, distinct[order], counts[order], b"".join(len(p).to_bytes(8, "little") + p for p in map(pack, parts))

    @staticmethod
    def unpacked(docs: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        parts, at = [], 0
        while at < len(docs):
            n = int.from_bytes(docs[at:at + 8], "little")
            parts.append(zstandard.ZstdDecompressor().decompress(docs[at + 8:at + 8 + n]))
            at += 8 + n
        table = pa.ipc.open_stream(parts[0]).read_all()
        places, repeats = (np.ascontiguousarray(np.frombuffer(p, "u1").reshape(4, -1).T).view("<u4").ravel() for p in parts[1:])
        return table, places, repeats


def link_blocks(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: its distinct pairs (``b * ids of A + a``), their counts, packed documents."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _loaded(files)
        n_a, n_b = (len(s.tokens) for s in sides)
        names = _names(n_a, n_b)
        number = TaskContext.get().partitionId() << 32
        block = _Block()

        def done() -> pa.RecordBatch:
            row = block.row(number)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.list_(pa.int64())),
                 pa.array([row[2]], pa.list_(pa.int64())), pa.array([row[3]], pa.binary())],
                names=["block", "keys", "counts", "docs"])

        for batch in batches:
            for ids, texts in _chunks(batch, min(CHUNK_BYTES, block_bytes)):
                x = align(texts, sides)
                digests = [hashlib.sha256(w).hexdigest() if n else "" for w, n in zip(x.written(names, n_b), x.n_a.tolist())]
                block.add(ids, x, digests, n_a)
                block.bytes += sum(len(t or "") for t in texts)
                if block.bytes >= block_bytes:
                    yield done()
                    number, block = number + 1, _Block()
        if block.ids:
            yield done()

    return _texts(docs, id_col, text_col).mapInArrow(blocks, BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame, n_a_ids: int) -> DataFrame:
    """Corpus-wide links of each pair: key, total, best (no other pair of its second id has more)."""
    pairs = blocks.select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("p.keys", "p.counts")
    totals = pairs.groupBy(F.col("keys").alias("key")).agg(F.sum("counts").alias("total"))
    totals = shared_table(totals, "link-counts")
    second = F.floor(F.col("key") / n_a_ids)
    highest = totals.groupBy(second.alias("b")).agg(F.max("total").alias("highest"))  # a row for each id of B at most
    return (totals.join(highest, second == F.col("b"))
            .select("key", "total", (F.col("total") == F.col("highest")).alias("best")))


def alignment_report(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, links that are the best of their second id, the
    sum of their corpus-wide counts, and the SHA-256 of the written groups ('' without tokens)."""
    blocks = shared_table(link_blocks(docs, files, id_col, text_col, block_bytes), "link-blocks")
    counts = pair_counts(blocks, len(_loaded(files)[0].tokens))
    asked = blocks.select(F.col("block").alias("asking"), F.posexplode("keys").alias("place", "key"))
    known = asked.join(counts, "key").select("asking", "place", "total", "best")

    def summed(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        out = {f.name: [] for f in _report_schema()}
        for packed in block["docs"].to_pylist():
            table, places, repeats = _Block.unpacked(packed)
            total = np.zeros(known.num_rows, np.int64)
            best = np.zeros(known.num_rows, np.int64)
            at = known["place"].to_numpy()
            total[at], best[at] = known["total"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
            edges = np.cumsum(np.r_[0, table["size"].to_numpy()])
            sums = [np.diff(np.r_[0, np.cumsum(v[places] * repeats)][edges]) for v in (best, total)]
            values = [table["doc_id"], *(table[f"f{k}"] for k in range(4)), *sums, table["digest"]]
            for name, v in zip(out, values):
                out[name] += v.tolist() if isinstance(v, np.ndarray) else v.to_pylist()
        return pa.table(out, schema=_report_schema())

    return (blocks.select("block", "docs").groupBy("block").cogroup(known.groupBy("asking"))
            .applyInArrow(summed, REPORT))


def _report_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in REPORT.split(", "))])
