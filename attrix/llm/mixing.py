"""Mixing sources to target weights by balanced (cube) sampling.

Each source's target is its weighted share of all words, at most ``max_repeat`` times its own
words; what is cut off is shared again by weight.  A source
is then taken ``r = target / size`` times: every document ``floor(r)`` times, and
once more with the probability ``r - floor(r)``.  The cube method draws these
extra copies: it moves the vector of inclusion probabilities through the null
space of two constraints, documents and words, so each move keeps both totals,
until at most two documents are still undecided: a small landing problem.

Groups are buckets of one source with about ``bucket_rows`` documents each, so a source with a
third of all rows is many groups.  Within a group, flights run by size class
from long to short documents; what the landing of a class gains or loses is
carried into the next, so a group misses its share by a few short documents'
words.  Only ids, sizes and sources are shuffled.  Draws are seeded by source and bucket, so reruns agree.

Edge cases: null text has size 0 and is drawn like any other; a null source is
a source of its own, last in order; null ids are allowed; repeated rows are
drawn separately; a source without words has the target 0; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.llm.common import shared_table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUCKET_ROWS = 4096
SEED = 17


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """(source, n, source_size, weight, target) from (source, size) rows.

    The common factor of the weights rises until the uncapped sources share
    what the capped ones leave; each step is one small aggregate.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = (sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
              .withColumn("weight", weight))
    totals = shared_table(totals, "source-totals")
    cap = F.col("source_size") * float(max_repeat)
    capped = lambda factor: F.col("weight") * factor > cap
    factor, before = 0.0, -1
    while True:
        over = capped(factor)
        row = totals.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("capped"),
                         F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n_over")).first()
        if row["open"] is None or row["n_over"] == before:
            break
        before = row["n_over"]
        factor = (float(row["all"] or 0) - (row["capped"] or 0.0)) / row["open"]
    return totals.withColumn("target", F.least(cap, F.col("weight") * factor))


def fly(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities towards 0 or 1, keeping their sum and size-weighted sum; at most two stay between."""
    chance = chance.astype(float).tolist()
    size = size.astype(float).tolist()
    active: list[int] = []
    draws = iter(rng.random(len(chance) + 4).tolist())
    for k in range(len(chance)):
        if 0.0 < chance[k] < 1.0:
            active.append(k)
        if len(active) == 3:
            a, b, c = active
            move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            active = _step(chance, active, move if any(move) else (1.0, -1.0, 0.0), next(draws))
    return np.array(chance)


def land(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw 0 or 1 for all documents.

    Flights run by size class, longest first.  The one or two documents that a flight
    leaves land by dropping the words constraint and then the documents one; the words
    this gains or loses are carried into the probabilities of the next class, so what
    remains at the end is a few short documents' worth.
    """
    out = np.zeros(len(size))
    kind = np.floor(np.log2(np.maximum(size, 1)))
    carry = 0.0
    for k in np.unique(kind)[::-1]:
        at = np.flatnonzero(kind == k)
        words = size[at].sum()
        wanted = (chance[at] * size[at]).sum() + carry
        drawn = fly(size[at], np.clip(chance[at] + carry / max(words, 1), 0.0, 1.0), rng).tolist()
        open_ = [i for i, p in enumerate(drawn) if 0.0 < p < 1.0]
        if len(open_) == 2:
            open_ = _step(drawn, open_, (1.0, -1.0), rng.random())
        for i in open_:
            drawn[i] = 1.0 if rng.random() < drawn[i] else 0.0
        out[at] = drawn
        carry = wanted - (out[at] * size[at]).sum()
    return out


def _step(chance: list[float], active: list[int], move: Sequence[float], draw: float) -> list[int]:
    """One random move along ``move`` or against it, as far as the cube allows; who is still undecided."""
    ahead = back = float("inf")
    for k, u in zip(active, move):
        if u > 0:
            ahead, back = min(ahead, (1 - chance[k]) / u), min(back, chance[k] / u)
        elif u < 0:
            ahead, back = min(ahead, -chance[k] / u), min(back, (chance[k] - 1) / u)
    by = ahead if draw * (ahead + back) < back else -back
    left = []
    for k, u in zip(active, move):
        p = chance[k] + by * u
        chance[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        if 0.0 < chance[k] < 1.0:
            left.append(k)
    return left


def _landed(seed: int, carried: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("size", "descending"), ("doc_id", "ascending")]))
        source = rows["source"][0].as_py()
        name = 1 << 32 if source is None else zlib.crc32(source.encode())
        rng = np.random.default_rng([seed, name, rows["bucket"][0].as_py()])
        extra = land(rows["size"].to_numpy(), rows["chance"].to_numpy(), rng).astype(np.int64)
        copies = pc.add(rows["whole"], pa.array(extra))
        return rows.select(carried).append_column("copies", copies)
    return run


def draw_copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = 3.0,
                bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row of (doc_id, size, source) and maybe text_hash: adds source_size, target and copies."""
    carried = [c for c in ("doc_id", "size", "source", "source_size", "target", "text_hash") if c in (*sized.columns, "source_size", "target")]
    targets = shared_table(source_targets(sized, weights, max_repeat), "source-targets")
    renamed = targets.select(F.col("source").alias("__source"), "n", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(ratio, 9)
    rows = sized.join(renamed, F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.select(*carried, "n", F.floor(near).alias("whole"),
                       (near - F.floor(near)).alias("chance"))
    buckets = F.greatest(F.ceil(F.col("n") / bucket_rows), F.lit(1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), buckets).cast("int"))
    kinds = {"source": "string", "target": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*carried, "copies"])
    drawn = rows.groupBy("source", "bucket").applyInArrow(_landed(seed, carried), schema)
    return shared_table(drawn, "mix-draws")


def mix_decisions(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = 3.0, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size (words), source, source_size, target, text_hash, copies."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"),
                        F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return draw_copies(shared_table(sized, "mix-sizes"), weights, max_repeat)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = 3.0, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents with all their columns, a row for each time one is taken.

    Decisions meet the texts once, by id, source and text hash.  Rows that share all three share out what was
    drawn for them, in the order of a hash of all their columns; only such rows are numbered.
    """
    decisions = mix_decisions(docs, weights, max_repeat, id_col, text_col, source_col)
    taken = (decisions.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"))
             .agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0"))
    taken = shared_table(taken, "mix-taken").hint("merge")
    same = (F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
            & (F.xxhash64(F.col(text_col)) == F.col("__hash")))
    joined = docs.join(taken, same)
    order = Window.partitionBy("__id", "__source", "__hash").orderBy(F.xxhash64(*docs.columns))
    nth = F.row_number().over(order)
    whole = F.floor(F.col("__copies") / F.col("__rows"))
    share = whole + F.when(nth <= F.col("__copies") - whole * F.col("__rows"), 1).otherwise(0)
    once = joined.filter("__rows = 1")
    repeated = joined.filter("__rows > 1").withColumn("__copies", share).filter("__copies > 0")
    return (once.unionByName(repeated).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*docs.columns))
