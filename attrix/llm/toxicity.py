"""Toxicity by a classifier chain over labelled categories.

Linear models predict the categories one after another.  Each sees a
document's distinct words and their beginnings, hashed, and the
probabilities of the categories before it.  While training, those earlier
probabilities are predicted out of fold, so a later model learns from
probabilities as good as it will meet on new text.

Training uses all labelled rows up to about ``max_rows`` (a bounded
sample by a hash of the id: the documented bound of this operator), so a fold
fits one task; the folds of a category train side by side.  Scoring covers every row and whole
text without a shuffle: a linear model over distinct words is a sum of word
scores, which a bounded cache keeps in each Python worker.  The broadcast
models have a fixed size (1 MB a category), the sample's ids and labels one bounded by the same parameter.

Edge cases: null and empty texts have no words and get the models' base
probability; a document trains once: several label
rows count as the largest label of each category, several rows with one id as the
smallest text; null labels are skipped; a category without both labels in a training set gets its one label's
value as probability, or 0 without any; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from attrix.llm.common import shared_table

MAX_TRAINING_ROWS = 10_000
FOLDS = 4
FEATURES = 1 << 18
MIN_ROWS = 4
STEMS = (4, 6)
CACHED_WORDS = 300_000
SEED = 5

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [xxh3_64_intdigest(s) % FEATURES for s in (word, *[f"{n}^{word[:n]}" for n in STEMS])]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


# ----------------------------------------------------------------- training
def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """The hashed features of many rows, end to end."""
    features: np.ndarray
    ends: np.ndarray
    scale: np.ndarray  # 1 / sqrt of a row's features

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Rows:
        """From packed 32-bit features, without a copy of each row."""
        packed = pa.concat_arrays(column.chunks).cast(pa.large_binary())
        bounds = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1] // 4
        features = np.frombuffer(packed.buffers()[2] or b"", "<i4")[bounds[0]:bounds[-1]]
        return cls(features, bounds[1:] - bounds[0], 1 / np.sqrt(np.maximum(1, np.diff(bounds))))

    def row(self, k: int) -> np.ndarray:
        return self.features[self.ends[k - 1] if k else 0:self.ends[k]]

    def renumbered(self, number: np.ndarray) -> Rows:
        """Features by new numbers, without those that have none (-1); the scale stays."""
        new = number[self.features]
        kept = np.r_[0, np.cumsum(new >= 0)]
        return Rows(new[new >= 0], kept[self.ends], self.scale)

    def sums(self, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the weights of the rows' features, with these features and the row of each."""
        parts = [self.row(k) for k in at.tolist()]
        found = np.concatenate([*parts, np.empty(0, np.int32)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return np.bincount(owner, weights[found], len(parts)), found, owner


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, use: np.ndarray, epochs: int = 12, least_steps: int = 1500,
               size: int = 128, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by Adam on the rows ``use``: weights of the hashed features, then of ``extra``, then the bias.

    Features on fewer than ``MIN_ROWS`` rows are left out: they only help to
    learn rows by heart.  A single label gives the bias alone.
    """
    out = np.zeros(FEATURES + extra.shape[1] + 1)
    share = y[use].mean() if len(use) else 0.0
    if share in (0.0, 1.0):
        out[-1] = 30.0 if share else -30.0
        return out
    seen = np.zeros(FEATURES, np.int32)
    for k in use.tolist():
        seen[np.unique(rows.row(k))] += 1
    known = np.flatnonzero(seen >= MIN_ROWS)
    number = np.full(FEATURES, -1, np.int32)
    number[known] = np.arange(len(known))
    rows = rows.renumbered(number)
    m, n = len(known), len(known) + extra.shape[1] + 1
    weights, mean, square, step = np.zeros(n), np.zeros(n), np.zeros(n), 0
    weights[-1] = np.log(share / (1 - share))
    parts = max(1, len(use) // size)
    epochs = max(epochs, -(-least_steps // parts))
    rng = np.random.default_rng(SEED)
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(use), parts):
            total, found, owner = rows.sums(weights, at)
            z = total * rows.scale[at] + extra[at] @ weights[m:-1] + weights[-1]
            error = (_sigmoid(z) - y[at]) / len(at)
            slope = decay * weights
            slope[:m] += np.bincount(found, (error * rows.scale[at])[owner], m)
            slope[m:-1] += error @ extra[at]
            slope[-1] = error.sum()
            step += 1
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            weights -= pace * mean / (np.sqrt(square) + 1e-8)
    out[known], out[FEATURES:] = weights[:m], weights[m:]
    return out


def predict_linear(weights: np.ndarray, rows: Rows, extra: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.empty(0), *[rows.sums(weights, part)[0] for part in np.array_split(at, len(at) // 256 + 1)]])
    return _sigmoid(total * rows.scale[at] + extra[at] @ weights[FEATURES:-1] + weights[-1])


def training_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = MAX_TRAINING_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, fold, words, <category>...) of about ``max_rows`` labelled documents, chosen by a hash of their ids."""
    one = labels.groupBy(F.col(id_col).alias("__id")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    one = shared_table(one, "toxicity-labels")
    total = one.count()
    parts = 1_000_000 * max(1, total // 10 ** 8)  # finer with more labels, so that a small share is not rounded to none
    spread = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(parts))
    chosen = F.broadcast(one.filter(spread < int(min(1.0, max_rows / max(1, total)) * parts)))
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    joined = (texts.join(chosen, F.col("__key") == F.col("__id")).groupBy("__key", *categories)
              .agg(F.min("__text").alias("__text")).select("__key", "__text", *categories))

    def featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.array([f for w in sorted(distinct_words(t)) for f in word_features(w)], "<u4").tobytes()
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), *batch.columns[2:]],
                                             names=["key", "words", *categories])

    columns = "".join(f", {c} int" for c in categories)
    rows = joined.mapInArrow(featurized, f"key long, words binary{columns}")
    return shared_table(rows.withColumns({"row": F.monotonically_increasing_id(),
                                          "fold": F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(FOLDS)).cast("int")}),
                        "toxicity-sample")


def _fold_fit(category: str, earlier: Sequence[str]):
    def fitted(table: pa.Table) -> pa.Table:
        """Fit without one fold and predict it; without none (-1), return the weights."""
        table = table.sort_by([("key", "ascending"), ("row", "ascending")])
        ids, rows = table["row"].to_numpy(), Rows.of(table["words"])
        extra = np.stack([table[p].to_numpy() for p in earlier], axis=1) if earlier else np.empty((len(ids), 0))
        y = table[category].to_numpy().astype(float)  # null labels become NaN
        without = table["without"][0].as_py()
        held = table["fold"].to_numpy() == without
        del table
        use, out = np.flatnonzero(~held & ~np.isnan(y)), np.flatnonzero(held)
        weights = fit_linear(rows, extra, y, use)
        guess = predict_linear(weights, rows, extra, out)
        model = [weights.astype("<f4").tobytes()] if without < 0 else []
        return pa.table({"row": pa.array([*ids[out].tolist(), *[None] * len(model)], pa.int64()),
                         "p": pa.array([*guess.tolist(), *[None] * len(model)], pa.float64()),
                         "weights": pa.array([*[None] * len(out), *model], pa.binary())})
    return fitted


def _never(earlier: int) -> np.ndarray:
    """The model of a category without any labelled row."""
    return np.r_[np.zeros(FEATURES + earlier), -30.0]


def best_threshold(p: np.ndarray, y: np.ndarray, most_false: float = 0.002) -> float:
    """The cut of held-out probabilities with the best F1, with at most ``most_false`` of the negatives above it."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    right = np.cumsum(y)
    wrong = np.arange(1, len(y) + 1) - right
    f1 = np.where(wrong <= most_false * (y == 0).sum(), 2 * right / (np.arange(1, len(y) + 1) + y.sum()), 0.0)
    k = int(np.argmax(np.where(np.r_[p[1:] != p[:-1], True], f1, -1.0)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def fit_chain(sample: DataFrame, categories: Sequence[str]) -> tuple[list[np.ndarray], list[float]]:
    """One model and threshold a category, in order; earlier probabilities are out of fold while training.

    Thresholds come from the out-of-fold probabilities of the (bounded) sample.
    """
    rows, models, thresholds = sample, [], []
    for k, category in enumerate(categories):
        earlier = [f"p_{c}" for c in categories[:k]]
        folds = F.explode(F.array(*[F.lit(f) for f in range(-1, FOLDS)])).alias("without")
        fits = (rows.select("row", "key", "fold", "words", *earlier, category, folds).groupBy("without")
                .applyInArrow(_fold_fit(category, earlier), "row long, p double, weights binary"))
        fits = shared_table(fits, f"chain-{k}")
        found = fits.filter("weights is not null").select("weights").collect()  # one row of fixed size
        models.append(np.frombuffer(found[0][0], "<f4") if found else _never(k))
        rows = rows.join(fits.filter("row is not null").select("row", F.col("p").alias(f"p_{category}")), "row")
        held = rows.filter(F.col(category).isNotNull()).select(f"p_{category}", category).toArrow()
        thresholds.append(best_threshold(held[0].to_numpy(), held[1].to_numpy()))
    return models, thresholds


# ------------------------------------------------------------------ scoring
class WordScores(dict):
    """What a distinct word adds to each model's sum, for at most ``CACHED_WORDS`` words."""

    def __init__(self, models: np.ndarray):
        self.models = models

    def __missing__(self, word: str) -> tuple[float, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = tuple(self.models[:, word_features(word)].sum(axis=1).tolist())
        return value


class ChainScorer:
    """Probabilities of each category for Arrow columns of texts; models travel as one broadcast."""

    def __init__(self, spark: SparkSession, models: Sequence[np.ndarray]):
        self.shared = spark.sparkContext.broadcast([np.asarray(m) for m in models])
        self.words: WordScores | None = None

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        models = self.shared.value
        if self.words is None:
            self.words = WordScores(np.stack([m[:FEATURES] for m in models]))
        sums, scale = np.zeros((len(texts), len(models))), np.ones(len(texts))
        for i, text in enumerate(texts):
            found = distinct_words(text.as_py())
            if found:
                sums[i] = [sum(s) for s in zip(*map(self.words.__getitem__, sorted(found)))]
                scale[i] = 1 / np.sqrt(len(found) * (1 + len(STEMS)))
        out: list[np.ndarray] = []
        for k, model in enumerate(models):
            more = model[FEATURES:].astype(float)
            z = sums[:, k] * scale + more[-1]
            for earlier, weight in zip(out, more):
                z = z + weight * earlier
            out.append(_sigmoid(z))
        return out


def score_chain(docs: DataFrame, models: Sequence[np.ndarray], categories: Sequence[str], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: its id and p_<category> for each category."""
    scorer = ChainScorer(docs.sparkSession, models)
    names = [f"p_{c}" for c in categories]
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scorer(batch.column(1)))], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(scored, ", ".join([f"`{id_col}` {kind}", *[f"{n} double" for n in names]]))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"),
               rejected: Sequence[str] = ("toxic",), id_col: str = "doc_id", text_col: str = "text",
               max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents that ``judge_toxicity`` keeps, with all their columns; nothing is joined or shuffled."""
    models, thresholds = fit_chain(training_sample(docs, labels, categories, max_rows, id_col, text_col), categories)
    scorer, at = ChainScorer(docs.sparkSession, models), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scorer(batch.column(at))
            toxic = np.zeros(batch.num_rows, bool)
            for category, probability, threshold in zip(categories, p, thresholds):
                if category in rejected:
                    toxic |= probability >= threshold
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(kept, docs.schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"),
                   rejected: Sequence[str] = ("toxic",), id_col: str = "doc_id", text_col: str = "text",
                   max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per document: its id, p_<category> for each category, toxic, kept.

    ``toxic`` means that a category of ``rejected`` reaches its held-out threshold.
    """
    sample = training_sample(docs, labels, categories, max_rows, id_col, text_col)
    models, thresholds = fit_chain(sample, categories)
    scored = score_chain(docs, models, categories, id_col, text_col)
    over = F.lit(False)
    for category, threshold in zip(categories, thresholds):
        if category in rejected:
            over = over | (F.col(f"p_{category}") >= threshold)
    return scored.withColumn("toxic", over).withColumn("kept", ~F.col("toxic"))
