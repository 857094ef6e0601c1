"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become token ids; those longer than a sequence are cut into pieces.
Pieces are dealt over blocks of about ``block_rows`` by a hash of a row number, so
copies of one document spread too, and the number of blocks follows the input.  Each block
is packed by several islands: an island evolves whole packings, a crossover
injects well-filled bins of one parent into the other, removes the bins that
now hold a piece twice, and best-fits the displaced pieces, longest first.
After each round every island sends its elite to the next island of its block.
A packing that meets the block's lower bound is optimal and stops evolving.
Finally the best packing of each block is kept.

Tokens of a word do not depend on its neighbours beyond ASCII space, so words
are looked up in a bounded cache in each Python worker and only new ones are
encoded.

Edge cases: null and empty texts have the closing token alone; null ids are
kept; repeated rows are packed separately; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import shared_table

CAPACITY = 2048
BLOCK_ROWS = 16_384
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 4
POPULATION = 3
SEED = 23
CACHED_WORDS = 1_000_000
LATIN = 0x250  # letters below are Latin
WELL_FILLED = 0.97

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE_SCHEMA = "block long, island int, rows binary, lengths binary, packing binary, bins long, fitness double, done boolean"


# ------------------------------------------------------------------- tokens
class WordTokens(dict):
    """Token ids (as little-endian bytes) of words, at most ``limit`` of them.

    The tokenizer lower-cases, drops white space and cuts at the ends of
    letter runs before it merges.  So a word of plain Latin letters goes to
    its merges directly, punctuation after letters is looked up apart, and
    every other word is encoded by the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # text is only ever text
        self.merges = self.tokenizer.model.tokenize
        self.limit = limit
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        # how the tokenizer writes bytes: letters as they are, the bytes of others as characters of their own
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x80, LATIN)) if c.isalpha()}

    def encode(self, text: bytes | None) -> bytes:
        # bytes split at the six ASCII spaces; only A-Z are lower-cased here
        return b"".join(map(self.__getitem__, text.lower().split())) if text else b""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self._tokens(word)
        return value

    def _tokens(self, word: bytes) -> bytes:
        text = word.decode()
        letters = text.rstrip(".,!?;:")
        if letters.isascii() and letters.isalpha():
            plain = letters
        elif (letters.isalpha() and ord(max(letters)) < LATIN and letters == letters.lower()
              and is_normalized("NFC", letters)):
            plain = letters.translate(self.written)
        else:
            return self._joined(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if letters == text:
            return self._joined([t.id for t in self.merges(plain)])
        return self[letters.encode()] + self._joined(
            self.tokenizer.encode(text[len(letters):], add_special_tokens=False).ids)

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join([self.ids[i] for i in ids])


@lru_cache(maxsize=1)
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(tokens.encode(text.as_py()) + end)
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    chunk = ids[4 * start:4 * (start + capacity)]
                    out.append((doc, k, start, len(chunk) // 4, zlib.crc32(chunk)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32()] + [pa.int64()] * 3)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(cut, PIECE_SCHEMA)


# ------------------------------------------------------------------ packing
def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: all tokens, or pieces too long to share a bin plus what must overflow them."""
    best = -(-int(lengths.sum()) // capacity)
    for small in np.unique(lengths[2 * lengths <= capacity]):
        alone = lengths > capacity - small
        half = (2 * lengths > capacity) & ~alone
        rest = int(lengths[(2 * lengths <= capacity) & (lengths >= small)].sum())
        room = int(half.sum()) * capacity - int(lengths[half].sum())
        best = max(best, int(alone.sum() + half.sum()) + max(0, -(-(rest - room) // capacity)))
    return max(best, int((2 * lengths > capacity).sum()))


def best_fit(lengths: np.ndarray, order: np.ndarray, packing: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` one by one where the least room is left; changes ``packing`` and ``fill``."""
    shortest = int(lengths[order].min()) if len(order) else 0
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if capacity - f >= shortest)
    for k, need in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
            fill[b] += need
        else:
            left, b = capacity, len(fill)
            fill.append(need)
        packing[k] = b
        if left - need >= shortest:
            insort(room, (left - need, b))


def _fitness(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(packing, weights=lengths)
    return len(fill), float(np.mean((fill / capacity) ** 2))


def crossover(lengths: np.ndarray, first: np.ndarray, second: np.ndarray, rng: np.random.Generator,
              capacity: int = CAPACITY) -> np.ndarray:
    """A child of ``first`` with some of ``second``'s well-filled bins."""
    fill = np.bincount(second, weights=lengths)
    injected = (fill >= WELL_FILLED * capacity) & (rng.random(len(fill)) < rng.uniform(0.05, 0.3))
    moved = injected[second]
    broken = np.zeros(first.max() + 1, bool)
    broken[first[moved]] = True
    # the least filled bins are broken up too: their pieces may fill others
    own = np.bincount(first, weights=lengths)
    broken |= (own < WELL_FILLED * capacity) & (rng.random(len(own)) < 0.3)
    displaced = broken[first] & ~moved
    child = np.full(len(first), -1)
    stays = ~broken[first] & ~moved
    kept, child[stays] = np.unique(first[stays], return_inverse=True)
    new, ranks = np.unique(second[moved], return_inverse=True)
    child[moved] = ranks + len(kept)
    settled = child >= 0
    bins = np.bincount(child[settled], weights=lengths[settled], minlength=len(kept) + len(new)).astype(int).tolist()
    order = np.flatnonzero(displaced)
    order = order[np.lexsort((rng.random(len(order)), -lengths[order]))]
    best_fit(lengths, order, child, bins, capacity)
    return child


def evolve(lengths: np.ndarray, parents: list[np.ndarray], rng: np.random.Generator, capacity: int,
           generations: int, population: int) -> tuple[np.ndarray, bool]:
    """The best packing after some generations, and whether it is known to be optimal."""
    bound = lower_bound(lengths, capacity)
    while len(parents) < population:
        # best fit, longest first; later parents start from blurred lengths
        blur = lengths * (1 + 0.1 * rng.random(len(lengths)) * bool(parents))
        packing, fill = np.full(len(lengths), -1), []
        best_fit(lengths, np.argsort(-blur, kind="stable"), packing, fill, capacity)
        parents.append(packing)
        if len(fill) <= bound:
            return packing, True

    def rank(p: np.ndarray) -> tuple[int, float]:
        bins, fitness = _fitness(lengths, p, capacity)
        return bins, -fitness

    pool = sorted(((rank(p), n, p) for n, p in enumerate(parents)), key=lambda x: x[:2])[:population]
    born = len(parents)
    for _ in range(generations):
        if pool[0][0][0] <= bound:
            break
        for _ in range(population - 1):
            a, b = rng.choice(len(pool), 2, replace=False) if len(pool) > 1 else (0, 0)
            child = crossover(lengths, pool[a][2], pool[b][2], rng, capacity)
            born += 1
            pool.append((rank(child), born, child))
        pool = sorted(pool, key=lambda x: x[:2])[:population]
    return pool[0][2], pool[0][0][0] <= bound


def _evolved(block: int, island: int, turn: int, rows: bytes, lengths: np.ndarray, parents: list[np.ndarray],
             capacity: int, generations: int, population: int, seed: int) -> pa.Table:
    rng = np.random.default_rng([seed, block, island, turn])
    best, done = evolve(lengths, parents, rng, capacity, generations, population)
    bins, fitness = _fitness(lengths, best, capacity)
    return pa.table({"block": pa.array([block], pa.int64()), "island": pa.array([island], pa.int32()),
                     "rows": [rows], "lengths": [lengths.astype("<i4").tobytes()], "packing": [best.astype("<i4").tobytes()],
                     "bins": pa.array([bins], pa.int64()), "fitness": [fitness], "done": [done]})


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, islands: int = ISLANDS,
                rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION,
                seed: int = SEED) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is at most ``capacity``."""
    pieces = shared_table(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    dealt = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        return _evolved(table["block"][0].as_py(), table["island"][0].as_py(), 0,
                        table["row"].to_numpy().astype("<i8").tobytes(), table["length"].to_numpy(), [],
                        capacity, generations, population, seed)

    everywhere = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
    state = dealt.select("row", "length", "block", everywhere)
    state = shared_table(state.groupBy("block", "island").applyInArrow(settle, STATE_SCHEMA), "islands-0")

    def migrated(turn: int):
        def run(table: pa.Table) -> pa.Table:
            lengths = np.frombuffer(table["lengths"][0].as_py(), "<i4").astype(np.int64)
            table = table.sort_by([("bins", "ascending"), ("fitness", "descending")])
            parents = [np.frombuffer(p, "<i4").astype(np.int64) for p in table["packing"].to_pylist()]
            return _evolved(table["block"][0].as_py(), table["island"][0].as_py(), turn, table["rows"][0].as_py(),
                            lengths, parents, capacity, generations, population, seed)
        return run

    for turn in range(1, rounds):
        solved = state.filter("done").select(F.col("block").alias("__block")).distinct()
        open_ = state.join(solved, F.col("block") == F.col("__block"), "left_anti")
        finished = state.join(solved, F.col("block") == F.col("__block"), "left_semi")
        elites = open_.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        state = finished.unionByName(
            open_.unionByName(elites).groupBy("block", "island").applyInArrow(migrated(turn), STATE_SCHEMA))
        state = shared_table(state, f"islands-{turn}")

    best = state.groupBy("block").agg(F.max_by(F.struct("rows", "lengths", "packing"),
                                               F.struct(-F.col("bins"), F.col("fitness"), -F.col("island"))).alias("b"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows, lengths = np.frombuffer(x["rows"], "<i8"), np.frombuffer(x["lengths"], "<i4").astype(np.int64)
                bins = np.frombuffer(x["packing"], "<i4").astype(np.int64)
                order = np.lexsort((rows, bins))
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                first = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
                before = np.repeat(starts[first], np.diff(np.r_[first, len(order)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[order]), pa.array(x["block"] * (1 << 32) + bins[order]), pa.array(starts - before)],
                    names=["row", "sequence_id", "offset"])

    places = best.select("block", "b.*").mapInArrow(placed, "row long, sequence_id long, offset long")
    return pieces.join(places, "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """Token pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity, **options)
