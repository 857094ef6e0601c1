"""A probabilistic suffix tree over words, learned from a corpus and scored on it.

The next word is predicted from the longest context (the last one, two, ...
words) that is a state of the tree; without any, from the words' own frequencies.

*Smoothing.*  ``P(w | s) = (c(s w) + mu * P(w | suffix of s)) / (c(s) + mu)``, down to
``(c(w) + a) / (N + a * (V + 1))`` for the empty context.  So every distribution sums to one.

*States.*  A context is a candidate if it was seen ``MIN_COUNT`` times, whatever the size of the corpus.  It becomes a state
if its distribution diverges from its suffix's: the summed log ratio of the two over its training
occurrences, each judged by the counts without itself, reaches ``min_gain`` nats.

*Counting.*  Documents are packed into blocks of about ``block_bytes`` as they are read, words as
numbers of the block's own vocabulary, and written once, bucketed by block, so that no round shuffles them.  A block asks for
the counts of its distinct n-grams: keys dealt into buckets by their top bits, which sum them over all blocks and
answer in the order asked.  One round a context length (only below candidates), then one
for the contexts' gains; so all rounds are one kind of exchange.  Its answers join a table bucketed like the blocks, so each is
shuffled once, and its shuffle files go when they are written.  A round whose contexts cover
more than a quarter of the tokens takes ``PASSES`` steps, each for a range of the keys, so that less is on disk at a time.
A block sends an n-gram once however often it
occurs, and buckets are dealt by n-gram, so a word or context that is everywhere is one entry a block.
Number of blocks, buckets and n-grams follow the corpus; nothing is broadcast or collected but two totals and two sizes a round.

*Keys.*  Words go by hashes of about ``2 * log2(tokens)`` bits (48 to 64), so that about one pair of words at most
shares one; those that do are one word.  Their buckets number them, and number the candidates of every length.  A
longer n-gram's key is its context's number beside its last word's, scattered by a bijection (:func:`_gram_keys`): half as
many bits as a hash needs, and no two n-grams share a key.  Gains are asked by the candidates' numbers.

*Settled n-grams.*  If an n-gram's beginning or its end (the n-gram without its last or its first word) is in one block only,
held-out texts included, so is the n-gram: that block knows the count and doesn't ask, unless the n-gram is a candidate.

Gains are summed as integers, so reruns agree.

Edge cases: null and empty texts have the end token alone; null ids count as
training documents; repeated rows are counted and scored each; a text longer than a block is a
block of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from attrix.llm.common import shared_table
from attrix.llm.word_hashes import mixed
from attrix.session import BucketedTable, brief_shuffles, owned_tables

DEPTH = 3
MIN_COUNT = 32
MIN_GAIN = 8.0
MU = 60.0
ALPHA = 0.1
BLOCK_BYTES = 6 << 20
BUCKET_TOKENS = 2_000_000
PASSES = 2
GAIN_UNIT = 64  # gains are summed in 1/64 nats
END = 0x5EED0FE9D0C0FFEE  # the hash that stands for the end token
_TWIST = np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ASK = "bucket int, block long, round int, keys binary, amounts binary"
ANSWER = ("block long, round int, bucket int, sums binary, gate binary, marks binary, names binary, "
          "distinct long, total long, named long, marked long, covered long")
ANSWERED = ("block", "round", "bucket", "sums", "gate", "marks", "names")
GATED, LOCAL = np.uint8(1), np.uint8(2)  # an n-gram is a candidate as a context; no other block has it
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, mean_context double")


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


# ------------------------------------------------------------------ packing
def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` of uint64 with the inverse: leading bits and positions are sorted as one number, which needs no argsort.

    Values that differ in bits beyond those can come out of order; then ``np.unique`` is called."""
    n = len(values)
    if not n:
        return values, np.empty(0, np.int64)
    base = values.min()
    bits = n.bit_length()
    cut = np.uint64(max(0, int(values.max() - base).bit_length() + bits - 64))
    packed = np.sort((((values - base) >> cut) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    at = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = values[at] if cut else (packed >> np.uint64(bits)) + base
    if cut and (ordered[1:] < ordered[:-1]).any():
        return np.unique(values, return_inverse=True)
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(first) - 1
    return ordered[first], place


def _planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + _zip.compress(planes.tobytes())


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(_unzip.decompress(data[8:]), "u1")
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, "<u8"), dtype=np.uint64)


def _pack_amounts(v: np.ndarray) -> bytes:
    return _planes(((v << 1) ^ (v >> 63)).astype("<i8"))  # small negative numbers become small too


def _unpack_amounts(data: bytes) -> np.ndarray:
    v = _unplanes(data, "<i8")
    return (v >> 1) ^ -(v & 1)


# ------------------------------------------------------------------- blocks
def _token_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's tokens as hashes: its words, A-Z lower-cased, and the end.  A word is hashed once however often it occurs."""
    column = pa.array([t.translate(_LOWER).strip(_SPACES) for t in texts], pa.large_binary()).view(pa.large_string())
    words = pc.ascii_split_whitespace(column)
    lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
    blank = pc.binary_length(column).to_numpy() == 0  # split into one empty word
    words = words.filter(pa.array(~blank)).flatten().dictionary_encode()
    hashes = [xxh3_64_intdigest(w) for w in words.dictionary.view(pa.large_binary()).to_pylist()]
    edges = np.cumsum(np.where(blank, 0, lengths) + 1)
    tokens = np.full(edges[-1], END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[edges - 1] = False
    tokens[inner] = np.array(hashes, np.uint64)[words.indices.to_numpy()]
    return np.split(tokens, edges[:-1])


def _block_row(number: int, docs: list[tuple[int | None, bool, np.ndarray]]) -> tuple:
    ids, held, tokens = zip(*docs)
    lengths = np.array([len(t) for t in tokens])
    hashes, place = _distinct(np.concatenate(tokens))
    order = np.argsort(-np.bincount(place), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return (number, list(ids), list(held), lengths.tolist(), int(lengths.sum()), _pack_keys(hashes[order]),
            _planes(rank[place].astype("<u4")))


BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, n long, vocabulary binary, words binary"


def text_blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents packed by block, in the order they are read."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            ids, out, texts = zip(*held)
            row = _block_row(number, list(zip(ids, out, _token_hashes(texts))))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or b""
                held.append((doc, out, text))
                size += len(text) + 64
                if size >= block_bytes:
                    yield done()
                    number, held, size = number + 1, [], 0
        if held:
            yield done()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"),
                        F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(pack, BLOCK)


def _gram_keys(context: np.ndarray, word: np.ndarray, word_bits: int, width: int) -> np.ndarray:
    """Evenly spread keys of ``width`` bits for (context's number, word's number), different for different ones; beyond 64 bits, hashes."""
    if width > 64:
        return mixed(context * _TWIST + mixed(word))
    low, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    x = (context << np.uint64(word_bits)) | word
    for _ in range(2):
        x = ((x ^ (x >> half)) * _TWIST) & low
    return x ^ (x >> half)


class _Layout:
    """Bits of the keys a round, as far as they are known, and of the numbers they are made of."""

    def __init__(self, shift: int, bits: int):
        self.shift, self.bits, self.words, self.contexts, self.widths = shift, bits, 0, (), (64 - shift,)

    def after(self, named: int, marked: int) -> _Layout:
        """The layout once a round's most numbers a bucket are known: of words (the first round's) and of candidates."""
        out = _Layout(self.shift, self.bits)
        out.words = self.words if self.contexts else self.bits + named.bit_length()
        out.contexts = (*self.contexts, self.bits + marked.bit_length())
        out.widths = (*self.widths, out.contexts[-1] + out.words)
        return out

    def buckets(self, k: int, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(min(64, self.widths[k]) - self.bits) if self.bits else np.zeros(len(keys), np.uint64)

    def part(self, buckets: np.ndarray, passes: int) -> np.ndarray:
        """The pass that asks a bucket."""
        return (buckets * np.uint64(passes)) >> np.uint64(self.bits)

    def numbers(self, k: int, keys: np.ndarray, ranks: np.ndarray, width: int) -> np.ndarray:
        """Corpus-wide numbers from the ranks within buckets."""
        return (self.buckets(k, keys) << np.uint64(width - self.bits)) | ranks


class _Replay:
    """A block's n-grams, as far as their counts are answered.

    ``grams[k]`` numbers the ``k + 1``-word gram that ends at each token (-1: its context is no candidate).
    Numbers follow the sorted keys ``keys[k]``; ``asked[k]`` says which of them the block asks, in that order (the others are settled).
    ``own[k]`` has the block's training occurrences, ``counts[k]`` (once they are needed) the corpus counts.
    """

    def __init__(self, row: dict, answers: dict[int, dict], depth: int, layout: _Layout, min_count: int):
        self.row, self.depth, self.layout, self.min_count = row, depth, layout, min_count
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        words = _unplanes(row["words"], "<u4").astype(np.int32)
        n = len(words)
        place = (np.arange(n) - np.repeat(self.ends - self.lengths, self.lengths)).astype(np.int32)
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.keys, self.grams, self.own, self.asked, self.counts, self.ranks = [], [], [], [], [], []
        keys, number = _distinct(_unpack_keys(row["vocabulary"]) >> np.uint64(layout.shift))
        self._add(keys, number.astype(np.int32)[words], np.zeros(len(keys), bool))
        if not answers:
            return
        names = layout.numbers(0, keys, answers[0]["names"], layout.words)
        at = np.arange(n)
        for k in range(min(depth, len(answers))):
            gated, local, marks = self._answered(k, answers[k])
            context = self.grams[k]
            at = at[at > 0]
            at = at[(place[at] > k) & (context[at - 1] >= 0)]
            at = at[gated[context[at - 1]]]
            before, end = context[at - 1], context[at]
            keys, ids = _distinct(_gram_keys(marks[before], names[self.grams[0][at]], layout.words, layout.widths[k + 1]))
            grams = np.full(n, -1, np.int32)
            grams[at] = ids
            known = np.zeros(len(keys), bool)
            known[ids] = local[before] | (local[end] & (end >= 0))
            self._add(keys, grams, known)

    def _add(self, keys: np.ndarray, grams: np.ndarray, known: np.ndarray) -> None:
        own = np.bincount(grams[(grams >= 0) & self.train], minlength=len(keys))
        self.keys.append(keys)
        self.grams.append(grams)
        self.own.append(own)
        self.asked.append(~(known & (own < self.min_count)))

    def _answered(self, k: int, answer: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per gram: whether it is a candidate, whether only this block has it, and its number as a context."""
        flags = np.full(len(self.keys[k]), LOCAL)
        flags[self.asked[k]] = answer["gate"]
        gated = (flags & GATED) > 0
        ranks = np.zeros(len(flags), np.uint64)
        ranks[gated] = answer["marks"]
        self.ranks.append(ranks)
        return gated, (flags & LOCAL) > 0, self.layout.numbers(k, self.keys[k], ranks, self.layout.contexts[k])

    def count(self, answers: dict[int, dict]) -> None:
        """Corpus counts of all grams: as answered, or the block's own."""
        for k, own in enumerate(self.own):
            counts = own.copy()
            if k in answers:
                asked = np.flatnonzero(self.asked[k])
                counts[asked[(answers[k]["gate"] & LOCAL) == 0]] = answers[k]["sums"]
            self.counts.append(counts)

    def wanted(self, part: int, passes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The round, the buckets, keys and training occurrences in this block of the next grams, those of one part of the buckets."""
        k = len(self.grams) - 1
        buckets = self.layout.buckets(k, self.keys[k])
        asked = self.asked[k] & (self.layout.part(buckets, passes) == part)
        yield k, buckets[asked], self.keys[k][asked], self.own[k][asked]

    def root(self, total: int, distinct: int, alpha: float, without: int = 0) -> np.ndarray:
        counts = self.counts[0][self.grams[0]]
        return (np.maximum(counts - without * self.train, 0) + alpha) / (total - without + alpha * (distinct + 1))

    def deeper(self, k: int, parent: np.ndarray, mu: float, without: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with a candidate context of ``k`` words, that context's number, and their probabilities."""
        at = np.flatnonzero(self.grams[k] >= 0)
        context = self.grams[k - 1][at - 1]
        seen = np.maximum(self.counts[k][self.grams[k][at]] - without, 0)
        return at, context, (seen + mu * parent[at]) / (self.counts[k - 1][context] - without + mu)

    def gains(self, total: int, distinct: int, alpha: float, mu: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per context length: its round, buckets and ranks of the block's candidates, and their part of the gain over their suffixes."""
        p = self.root(total, distinct, alpha, 1)
        for k in range(1, len(self.grams)):
            at, context, q = self.deeper(k, p, mu, 1)
            gain = np.where(self.train[at], np.log(q / p[at]), 0.0)
            numbers = np.flatnonzero(np.bincount(context, minlength=len(self.keys[k - 1])))
            sums = np.bincount(context, weights=gain, minlength=len(self.keys[k - 1]))[numbers]
            buckets = self.layout.buckets(k - 1, self.keys[k - 1][numbers])
            yield self.depth + k, buckets, self.ranks[k - 1][numbers], np.rint(GAIN_UNIT * sums).astype(np.int64)
            p[at] = q

    def scores(self, total: int, distinct: int, alpha: float, mu: float, answers: dict[int, dict]) -> dict:
        p = self.root(total, distinct, alpha)
        best, depth, base = p.copy(), np.zeros(len(p), np.int64), np.log10(p)
        for k in range(1, len(self.grams)):
            at, context, q = self.deeper(k, p, mu)
            states = np.zeros(len(self.keys[k - 1]), bool)
            states[context] = True
            states[states] = answers[self.depth + k]["gate"] > 0 if len(at) else False
            p[at] = q
            at, q = at[states[context]], q[states[context]]
            best[at], depth[at] = q, k
        edges = self.ends - self.lengths
        known = (self.counts[0][self.grams[0]] > 0).astype(np.int64)
        summed = lambda v: np.add.reduceat(v, edges)
        return {"doc_id": self.row["doc_ids"], "held_out": self.row["held"], "n_tokens": self.lengths, "n_known": summed(known),
                "train_tokens": np.full(len(edges), total), "base_score": summed(base), "score": summed(np.log10(best)),
                "mean_context": summed(depth) / self.lengths}


def _answers(table: pa.Table) -> dict[int, dict[str, np.ndarray]]:
    """Per round, what the buckets answered, in the order asked."""
    unpack = {"gate": lambda d: _unplanes(d, "u1"), "marks": _unpack_keys, "names": _unpack_keys, "sums": _unpack_amounts}
    rows = sorted(table.to_pylist(), key=lambda r: (r["round"], r["bucket"]))
    rounds = {k: list(parts) for k, parts in groupby(rows, key=lambda r: r["round"])}
    return {k: {c: np.concatenate([f(p[c]) for p in parts]) for c, f in unpack.items() if c in table.column_names}
            for k, parts in rounds.items()}


def score_texts(docs: DataFrame, held_out: Column, depth: int = DEPTH, min_count: int = MIN_COUNT,
                min_gain: float = MIN_GAIN, mu: float = MU, alpha: float = ALPHA, id_col: str = "doc_id",
                text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, words alone), score
    (log10, the tree's) and the mean length of the states used.  Documents with ``held_out`` are only scored."""
    spark = docs.sparkSession
    texts, answered = BucketedTable(spark, "suffix-tree-blocks", "block"), BucketedTable(spark, "suffix-tree-answers", "block")
    texts.add(text_blocks(docs, held_out, id_col, text_col, block_bytes))
    blocks = texts.last_rows()
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    layout = _Layout(max(0, 64 - 2 * max(24, int(tokens).bit_length())), (int(tokens) // bucket_tokens).bit_length())

    # Functions are sent with the layout as it is when Spark is given them.
    def dealt(number: int, asked: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        rows = []
        for round_, own, keys, amounts in asked:
            edges = np.searchsorted(own, np.arange((1 << layout.bits) + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                span = slice(edges[b], edges[b + 1])
                rows.append((b, number, round_, _pack_keys(keys[span]), _pack_amounts(amounts[span])))
        kinds = {"bucket": pa.int32(), "block": pa.int64(), "round": pa.int32(), "keys": pa.binary(), "amounts": pa.binary()}
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    def summed(table: pa.Table) -> tuple[list[slice], np.ndarray, np.ndarray]:
        """A bucket's entries: the span of each block's, the rank of their keys, and by rank the sums over all blocks."""
        parts = [_unpack_keys(k) for k in table["keys"].to_pylist()]
        amounts = np.concatenate([_unpack_amounts(a) for a in table["amounts"].to_pylist()])
        keys, place = _distinct(np.concatenate(parts))
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, amounts)
        edges = np.cumsum([0] + [len(p) for p in parts]).tolist()
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])], place, sums

    def answer(table: pa.Table, gates: list[np.ndarray], **more: list) -> pa.Table:
        binary, nothing = [b""] * len(gates), [0] * len(gates)
        columns = {c: table[c] for c in ("block", "round", "bucket")}
        columns |= {c: pa.array(more.get(c, binary), pa.binary()) for c in ("sums", "marks", "names")}
        columns |= {c: pa.array(more.get(c, nothing), pa.int64()) for c in ("distinct", "total", "named", "marked", "covered")}
        columns["gate"] = pa.array([_planes(g) for g in gates], pa.binary())
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in ANSWER.split(", ")})

    def counts(key: tuple, table: pa.Table) -> pa.Table:
        """A bucket's counts over all blocks (where more than one asked), to each block in the order it asked, with the
        numbers of words and of candidates."""
        spans, place, sums = summed(table)
        gated, local, first = sums >= min_count, np.bincount(place) == 1, [0] * (len(spans) - 1)
        rank = np.cumsum(gated).astype(np.uint64) - np.uint64(1)
        mine = [place[s] for s in spans]
        words = key[0].as_py() == 0
        return answer(
            table, [gated[m] * GATED | local[m] * LOCAL for m in mine],
            sums=[_pack_amounts(sums[m[~local[m]]]) for m in mine], marks=[_pack_keys(rank[m[gated[m]]]) for m in mine],
            names=[_pack_keys(m.astype(np.uint64)) if words else b"" for m in mine], distinct=[int((sums > 0).sum()), *first],
            total=[int(sums.sum()), *first], named=[len(sums), *first], marked=[int(gated.sum()), *first],
            covered=[int(sums[gated].sum()), *first])

    def verdicts(key: tuple, table: pa.Table) -> pa.Table:
        """Which of a bucket's candidates are states, to each block in the order it asked."""
        spans, place, sums = summed(table)
        states = (sums >= min_gain * GAIN_UNIT).astype("u1")
        return answer(table, [states[place[s]] for s in spans])

    def exchange(asks: DataFrame, answer) -> Row:
        """Adds the buckets' answers to those the blocks have; returns totals and sizes.  Shuffle files of a step go before the next."""
        with brief_shuffles(spark), owned_tables(spark):
            new = shared_table(asks.groupBy("round", "bucket").applyInArrow(answer, ANSWER), "suffix-tree-exchange")
            answered.add(new.repartition(answered.number, "block"))
            return new.agg(F.sum("distinct"), F.sum("total"), F.max("named"), F.max("marked"), F.sum("covered")).first()

    def replay(block: pa.Table, known: dict[int, dict]) -> _Replay:
        return _Replay(block.to_pylist()[0], known, depth, layout, min_count)

    def counted(block: pa.Table, known: dict[int, dict]) -> _Replay:
        out = replay(block, {k: a for k, a in known.items() if k < depth})
        out.count(known)
        return out

    per_block = blocks.groupBy("block")
    sizes = [exchange(per_block.applyInArrow(lambda key, block: dealt(key[0].as_py(), replay(block, {}).wanted(0, 1)), ASK), counts)]
    distinct, total = (x or 0 for x in sizes[0][:2])
    for round_ in range(1, depth + 1):
        layout = layout.after(*(max(x[k] or 0 for x in sizes) for k in (2, 3)))
        passes = PASSES if layout.bits and 4 * sum(x[4] or 0 for x in sizes) > total else 1
        gates = answered.rows().filter(F.col("round") < round_).select("block", "round", "bucket", "gate", "marks", "names")
        sizes = [exchange(per_block.cogroup(gates.groupBy("block")).applyInArrow(
            lambda key, block, gates: dealt(key[0].as_py(), replay(block, _answers(gates)).wanted(part, passes)), ASK), counts)
            for part in range(passes)]
    exchange(per_block.cogroup(answered.rows().select(*ANSWERED).groupBy("block")).applyInArrow(
        lambda key, block, known: dealt(
            key[0].as_py(), counted(block, _answers(known)).gains(total, distinct, alpha, mu)), ASK), verdicts)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCORES.split(", ")])

    def scored(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        found = _answers(known)
        scores = counted(block, found).scores(total, distinct, alpha, mu, found)
        return pa.table({f.name: pa.array(scores[f.name], f.type) for f in schema})

    return per_block.cogroup(answered.last_rows().select(*ANSWERED).groupBy("block")).applyInArrow(scored, SCORES)
