"""Periodic runs of words, found with multi-scale minimizers.

A run is a maximal stretch of words with smallest period ``q`` that holds at
least two periods (and ``min_length`` words).

Short periods, below ``2 ** (FIRST_SCALE + 1) - 1``, are scanned directly: the words
that equal the word ``q`` back form the stretches of lag ``q``.

Longer periods are sought scale by scale.  At scale ``j`` the ``2 ** j``-word
grams are hashed, and every window of ``2 ** j`` gram starts keeps its minima.
A run whose period is at least a window's span holds some window and
its copy one period later, so both keep equal minima ``q`` apart: pairs of equal minima at a
distance of the scale's periods are seeds.  A seed is extended both ways by binary
lifting over the gram hashes of all scales, and its stretch kept if it
holds two periods and no shorter period divides it.

Grams that are periodic themselves would pair up with all their neighbours.
They lie in runs found at smaller scales, and two grams in the same run never seed a
longer primitive period.  So for each pair of such runs with the same period only the lags that can
reach beyond them are tried: starts aligned, ends aligned, and, where the
two runs touch, the lags in phase.

Documents never meet: all of a batch's texts are one array of word hashes with
unique separators, by classes of length, so numpy works on whole batches and a
long text only costs the scales it needs.  Work is O(n log n) words plus the seeds.
Hashes have 64 bits; equal hashes count as equal words.

Edge cases: null and empty texts have no words and no runs; null ids and
repeated rows are kept as they are, row by row; a text longer than a chunk is
a chunk of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.word_hashes import mixed, run_starts, word_hashes

MIN_LENGTH = 12
FIRST_SCALE = 3
CHUNK_WORDS = 400_000
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
_TWIST = np.uint64(0x9E3779B97F4A7C15)


class _Grams:
    """Hashes of the ``2 ** j``-word grams of one array of word hashes, level by level."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.levels = [words]

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            half = 1 << (len(self.levels) - 1)
            h = self.levels[-1]
            # not linear in the halves, so structured texts do not cancel out
            self.levels.append(mixed(h[:-half] * _TWIST + mixed(h[half:])) if len(h) > half else h[:0])
        return self.levels[j]

    def equal_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on (``a < b``, elementwise)."""
        return self._lift(a, b, 1)

    def equal_behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``."""
        return self._lift(a, b, -1)

    def _lift(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        n, got = len(self.words), np.zeros(len(a), np.int64)
        room = n - b if way > 0 else a
        top = int(room.max()).bit_length() if len(a) else 0
        live = np.arange(len(a))
        j = 0  # gallop up while the whole gram is equal, then down
        while len(live) and j < top:
            live = live[self._same(a, b, got, room, live, j, way)]
            got[live] += 1 << j
            j += 1
        for k in range(j - 1, -1, -1):
            some = np.flatnonzero(self._same(a, b, got, room, slice(None), k, way))
            got[some] += 1 << k
        return got

    def _same(self, a, b, got, room, which, j, way) -> np.ndarray:
        h, done = self.level(j), got[which]
        fits = done + (1 << j) <= room[which]
        if way > 0:
            x, y = a[which] + done, b[which] + done
        else:
            x, y = a[which] - done - (1 << j), b[which] - done - (1 << j)
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        return fits & (h[x] == h[y]) if len(h) else fits


def _sliding(values: np.ndarray, j: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over windows of ``2 ** j``."""
    for k in range(j):
        values = pick(values[:-(1 << k)], values[1 << k:]) if len(values) > 1 << k else values[:0]
    return values


def _minima(grams: np.ndarray, j: int) -> np.ndarray:
    """Places of the grams that are least in some window of ``2 ** j`` grams (ties all count)."""
    least = _sliding(grams, j, np.minimum)
    if not len(least):
        return np.empty(0, np.int64)
    side = np.zeros((1 << j) - 1, np.uint64)
    greatest = _sliding(np.concatenate([side, least, side]), j, np.maximum)
    return np.flatnonzero(greatest == grams)


@lru_cache(maxsize=100_000)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


class _Runs:
    """Stretches (start, end, period) with their smallest period, each once."""

    def __init__(self, grams: _Grams):
        self.grams = grams
        self.found = np.empty((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Add the maximal stretches of lag ``period`` that hold two periods, if no divisor is a period too."""
        new = np.stack([start, end, period], 1)[end - start >= 2 * period]
        new = np.unique(new, axis=0)
        for prime in sorted({p for q in np.unique(new[:, 2]).tolist() for p in _prime_factors(q)}):
            shorter = new[:, 2] // prime
            tried = np.flatnonzero((new[:, 2] % prime == 0) & (shorter > 0))
            s, d = new[tried, 0], shorter[tried]
            periodic = self.grams.equal_ahead(s, s + d) >= new[tried, 1] - s - d
            new = np.delete(new, tried[periodic], axis=0)
        self.found = np.unique(np.concatenate([self.found, new]), axis=0)

    def extend(self, at: np.ndarray, lag: np.ndarray) -> None:
        """Extend seeds: the word (or nothing) at ``at`` equals the one ``lag`` on."""
        ahead = self.grams.equal_ahead(at, at + lag)
        behind = self.grams.equal_behind(at, at + lag)
        self.add(at - behind, at + lag + ahead, lag)


def _scan_short(runs: _Runs, top: int) -> None:
    """Direct scans of the lags 1 to ``top``; stretches from ``2 ** FIRST_SCALE`` words are kept for later scales."""
    words = runs.grams.words
    for q in range(1, min(top, len(words) - 1) + 1):
        equal = np.flatnonzero(words[q:] == words[:-q])
        if not len(equal):
            continue
        starts = run_starts(equal - np.arange(len(equal)))
        ends = np.r_[starts[1:], len(equal)]
        start, end = equal[starts], equal[ends - 1] + 1 + q
        long = end - start >= max(1 << FIRST_SCALE, 2 * q)
        runs.add(start[long], end[long], np.full(int(long.sum()), q))


def _inside(at: np.ndarray, size: int, runs: np.ndarray) -> np.ndarray:
    """Whether ``[at, at + size)`` lies within one of the runs."""
    if not len(runs) or not len(at):
        return np.zeros(len(at), bool)
    order = np.argsort(runs[:, 0], kind="stable")
    reach = np.maximum.accumulate(runs[order, 1])
    k = np.searchsorted(runs[order, 0], at, "right") - 1
    return (k >= 0) & (reach[np.maximum(k, 0)] >= at + size)


def _pairs_of_runs(runs: np.ndarray, grams: _Grams, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds between runs of the same short period: aligned starts, aligned ends, and lags in phase if they touch."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    at, lag = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, len(runs)):
        one, two = runs[:-step], runs[step:]
        near = (one[:, 2] == two[:, 2]) & (two[:, 0] - one[:, 1] + size <= high)
        if not near.any():
            break
        one, two = one[near], two[near]
        for edge, back in ((0, 0), (1, size)):
            d = two[:, edge] - one[:, edge]
            fits = (d >= low) & (d <= high)
            at.append(one[fits, edge] - back)
            lag.append(d[fits])
        for (a, b, d), (a2, b2, _) in zip(*(x[two[:, 0] <= one[:, 1]].tolist() for x in (one, two))):
            turn = np.flatnonzero(_same_block(grams.words, a, a2, d))
            for c in (a2 - a - turn).tolist():
                lags = np.arange(low + (c - low) % d, min(high, b - a, b2 - a2) + 1, d)
                at.append(np.maximum(a, a2 - lags))
                lag.append(lags)
    return np.concatenate(at), np.concatenate(lag)


def _same_block(words: np.ndarray, a: int, a2: int, d: int) -> np.ndarray:
    """For each turn below ``d``: do the ``d`` words from ``a + turn`` on equal those from ``a2`` on?"""
    block = words[a2:a2 + d]
    first = np.flatnonzero(words[a:a + d] == block[0])
    same = np.zeros(d, bool)
    same[[r for r in first.tolist() if np.array_equal(words[a + r:a + r + d], block)]] = True
    return same


def find_runs(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs (start, end, period) of an array whose separators are unique; texts have up to ``longest`` words."""
    grams = _Grams(words)
    runs = _Runs(grams)
    _scan_short(runs, min((1 << (FIRST_SCALE + 1)) - 2, longest // 2))
    j = FIRST_SCALE
    while (low := (1 << (j + 1)) - 1) <= longest // 2:
        size, high = 1 << j, min((1 << (j + 2)) - 2, longest // 2)
        h = grams.level(j)
        places = _minima(h, j)
        short = runs.found[(2 * runs.found[:, 2] <= size) & (runs.found[:, 1] - runs.found[:, 0] >= size)]
        places = places[~_inside(places, size, short)]
        order = np.argsort(h[places], kind="stable")
        places = places[order]
        keys = h[places]
        at, lag = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, len(places)):
            d = places[step:] - places[:-step]
            near = (keys[step:] == keys[:-step]) & (d <= high)
            if not near.any():
                break
            near &= d >= low
            at.append(places[:-step][near])
            lag.append(d[near])
        runs.extend(np.concatenate(at), np.concatenate(lag))
        if len(short) > 1:
            runs.extend(*_pairs_of_runs(short, grams, size, low, high))
        j += 1
    found = runs.found
    return found[found[:, 1] - found[:, 0] >= min_length]


def _chunk_runs(texts: list[np.ndarray], min_length: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, by start and period."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    classes: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if len(t) >= min_length:
            classes.setdefault(len(t).bit_length(), []).append(k)
    for bits, members in classes.items():
        lengths = np.array([len(texts[k]) for k in members])
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        joined = np.empty(int(ends[-1]), np.uint64)
        for k, s in zip(members, starts.tolist()):
            joined[s:s + len(texts[k])] = texts[k]
        joined[ends - 1] = mixed(np.arange(len(members), dtype=np.uint64) ^ np.uint64(0xABCDEF0123456789))
        found = find_runs(joined, int(lengths.max()), min_length)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        owner = np.searchsorted(ends, found[:, 0], "right")
        local = np.stack([found[:, 0] - starts[owner], found[:, 1] - found[:, 0], found[:, 2]], 1)
        edges = np.searchsorted(owner, np.arange(len(members) + 1))
        for k, a, b in zip(members, edges[:-1].tolist(), edges[1:].tolist()):
            out[k] = local[a:b]
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [w for w, n in zip(words, np.cumsum(steps[:-1]).tolist()) if not n]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text",
                  chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and kept_text,
    the text without the words that repeat a run's first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(ids: list, texts: list) -> pa.RecordBatch:
        words = [t.split() if t else [] for t in texts]
        runs = _chunk_runs([word_hashes(t) for t in texts], min_length)
        flat = np.concatenate([*runs, np.empty((0, 3), np.int64)])
        offsets = np.cumsum([0] + [len(r) for r in runs])
        kept = [b" ".join(_collapsed(w, r) if len(r) else w) for w, r in zip(words, runs)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                      pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1] or b"") // 6
                if size >= chunk_words:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(search, RESULT)
