"""Quality rules with thresholds that follow each language and source.

Each document gets its measures in one projection.  Mergeable KLL quantile
sketches summarise every measure per (language, source); a group's thresholds are fitted to its
sketch, and a join hands them back to the documents.

*Rates* (symbols, repeated lines, repeated words) are near zero in clean text and stand apart in junk.
Their fence is where the sketched distribution splits: the cut with the largest variance between
its two sides (of 200 quantiles and the maximum), taken if the upper side is a minority and stands apart from the
lower by ``APART`` times their deviations.  Below it a further cut is taken where there is a clean gap, at least as wide
as the values above it are spread, so two kinds of junk are both cut off.  A fence never cuts into a
group's bulk (twice the distance that a normal distribution with its quartiles has to its tenth), nor exceeds 1.

*Mean word length* has fences on both sides: the 10th and 90th percentile, ``REACH`` times their
distance from the median further out, and ``SLACK`` characters.

*Shrinkage.*  A group's fence is pulled towards its language's, and that towards the corpus's, as if ``prior_rows`` more rows
had been seen there; a group that does not split takes its language's.  So small groups follow their
language and large ones themselves, without a switch.

A rate's denominator counts a few clean units more (``CLEAN``), so that one repeat among three lines is not a third.

DataFrame functions only.  The sketches are pre-aggregated on the map side, so
a source with a third of all rows costs one sketch a task; only measures, no
text, are written and shuffled.  A group's quantiles are at most 201 rows a measure.

Edge cases: null text has no words and fails the base rules; null language or
source form groups of their own; repeated rows are judged alike; very long texts are measured whole; an empty
table gives an empty result; other columns are not read, and result names do not clash with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.llm.common import shared_table, without_spaces, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate")
LENGTH = "mean_word"
MEASURES = (LENGTH, *RATES)
CLEAN = {"symbol_rate": 0, "dup_line_rate": 4, "repeat_rate": 0}
POINTS = 200
CUTS = 3
APART = 2.0
MINORITY = 0.3
TO_TENTH = 1.9  # a normal's distance from median to 90th percentile, in distances to its 75th
REACH = 3.0
SLACK = 1.5
PRIOR_ROWS = 500


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    The hashes are sorted with their positions; equal neighbours give the
    repeated positions, and each covers the words up to the next one, five at
    most.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        def repeated(k: Column) -> Column:
            here = F.get(p, k)["h"]
            return here.eqNullSafe(F.get(p, k - 1)["h"]) | here.eqNullSafe(F.get(p, k + 1)["h"])
        ranks = F.filter(F.sequence(F.lit(0), F.size(p) - 1), repeated)
        return F.sort_array(F.transform(ranks, lambda k: F.get(p, k)["i"]))

    return F.get(F.transform(F.array(placed), starts), 0)  # binds the sorted array once


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines
    (columns of these names are replaced)."""
    found = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    others = [c for c in docs.columns if c != text_col and c not in found]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    tight = without_spaces(F.col(text_col))
    step = docs.select(*others, words(F.col(text_col)).alias("__words"), lines.alias("__lines"),
                       F.char_length(tight).cast("long").alias("word_chars"),
                       (F.char_length(tight) - F.char_length(F.translate(tight, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    last = F.size("__words") - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("__hashes", F.transform(starts, lambda i: F.xxhash64(
        *[F.get(F.col("__words"), i + k) for k in range(WINDOW)])))
    step = step.withColumn("__again", F.when(
        F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _repeat_words(F.col("__hashes")))
        .otherwise(F.array().cast("array<int>")))
    again = F.col("__again")
    covered = F.when(F.size(again) == 0, F.lit(0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.size(again)), F.lit(0),
        lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(F.get(again, k) - F.get(again, k - 1), F.lit(WINDOW)))))
    return step.select(*others, F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                       covered.cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"))


def _with_rates(measured: DataFrame) -> DataFrame:
    def rate(part: str, whole: str, clean: int = 0) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / (F.col(whole) + clean)).otherwise(F.lit(0.0))
    return measured.withColumns({
        LENGTH: rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "word_chars", CLEAN["symbol_rate"]),
        "dup_line_rate": rate("n_dup_lines", "n_lines", CLEAN["dup_line_rate"]),
        "repeat_rate": rate("n_repeat_words", "n_words", CLEAN["repeat_rate"])})


# ------------------------------------------------------------------- fences
def _points(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles of the rates: (keys, measure, i, v, w), the maximum last with half a point's weight."""
    ranks = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)], F.lit(1.0))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.kll_sketch_get_quantile_double(F.col(m), ranks).alias("q"))
                               for m in RATES])).alias("m")
    return (sketches.select(*keys, long).select(*keys, "m.measure", F.posexplode("m.q").alias("i", "v"))
            .withColumn("w", F.when(F.col("i") < POINTS, 1.0).otherwise(0.5)))


def _cut(points: DataFrame, keys: list[str]) -> DataFrame:
    """The best cut of each key's points: (keys, cut, low_end, gap, apart, share, spread)."""
    by = Window.partitionBy(*keys)
    upto = by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    w, v = F.col("w"), F.col("v")
    sums = points.select(
        *keys, "i", "v", F.lead("v").over(by.orderBy("i")).alias("next"), F.max("v").over(by).alias("top"),
        *[F.sum(x).over(upto).alias(f"{n}1") for n, x in (("w", w), ("v", w * v), ("s", w * v * v))],
        *[F.sum(x).over(by).alias(f"{n}0") for n, x in (("w", w), ("v", w * v), ("s", w * v * v))])
    w1, w2 = F.col("w1"), F.col("w0") - F.col("w1")
    m1, m2 = F.col("v1") / w1, (F.col("v0") - F.col("v1")) / w2
    d1 = F.sqrt(F.greatest(F.col("s1") / w1 - m1 * m1, F.lit(0.0)))
    d2 = F.sqrt(F.greatest((F.col("s0") - F.col("s1")) / w2 - m2 * m2, F.lit(0.0)))
    cut = F.struct((w1 * w2 * (m2 - m1) * (m2 - m1)).alias("between"), (-F.col("i")).alias("first"),
                   ((v + F.col("next")) / 2).alias("cut"), F.col("i").alias("low_end"), (F.col("next") - v).alias("gap"),
                   ((m2 - m1) / (d1 + d2 + 1e-9)).alias("apart"), (w2 / F.col("w0")).alias("share"),
                   (F.col("top") - F.col("next")).alias("spread"))
    return sums.filter(F.col("next") > v).groupBy(*keys).agg(F.max(cut).alias("c")).select(*keys, "c.*").drop("between", "first")


def _split(points: DataFrame, keys: list[str]) -> DataFrame:
    """Where each key's rates split, lowest accepted cut: (keys, fence)."""
    points = shared_table(points, "quality-points")
    first = _cut(points, keys).filter((F.col("apart") >= APART) & (F.col("share") <= MINORITY))
    taken = shared_table(first, "quality-cuts")
    cuts = [taken.select(*keys, "cut")]
    for _ in range(CUTS - 1):
        ends = taken.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("low_end").alias("__end"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        below = points.join(ends, same).filter("i <= __end").select(*points.columns)
        taken = shared_table(_cut(below, keys).filter((F.col("apart") >= APART) & (F.col("gap") >= F.col("spread"))
                                                      & (F.col("share") <= MINORITY)), "quality-cuts")
        cuts.append(taken.select(*keys, "cut"))
    return reduce(DataFrame.unionByName, cuts).groupBy(*keys).agg(F.min("cut").alias("fence"))


def _level(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per key: n, length fences and, where its rates split, their fences (named ``<measure>_<name>``)."""
    fences = _split(_points(sketches, keys), [*keys, "measure"])
    wide = fences.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_{name}") for m in RATES])
    q = {r: F.kll_sketch_get_quantile_double(F.col(LENGTH), F.lit(r)) for r in (0.1, 0.5, 0.9)}
    lengths = sketches.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n").alias(f"n_{name}"),
                              (q[0.1] - REACH * (q[0.5] - q[0.1]) - SLACK).alias(f"low_{name}"),
                              (q[0.9] + REACH * (q[0.9] - q[0.5]) + SLACK).alias(f"high_{name}"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else F.lit(True)
    return lengths.join(wide, same, "left").drop(*keys).withColumnsRenamed({f"__{k}": k for k in keys})


def fitted_fences(measured: DataFrame, prior_rows: int = PRIOR_ROWS, sketch_k: int = 1024) -> DataFrame:
    """Per (lang, source): ``<measure>_high`` of every measure and ``mean_word_low``; null where nothing is cut off.

    ``measured`` has lang, source, n_words and the measures; texts without words are left to the base rules.
    """
    sketches = shared_table(
        measured.filter("n_words > 0").groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(m).cast("double"), sketch_k).alias(m) for m in MEASURES]),
        "quality-sketches")

    def merged(keys: list[str]) -> DataFrame:
        return shared_table(sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in MEASURES])
                            .filter("n > 0"), "quality-sketches")

    corpus = _level(merged([]).withColumn("all", F.lit(0)), ["all"], "corpus").first()  # one row
    whole = corpus.asDict() if corpus else {}

    def of_corpus(name: str) -> Column:
        return F.lit(whole.get(f"{name}_corpus")).cast("double")

    langs = _level(merged(["lang"]), ["lang"], "lang").withColumnRenamed("lang", "__lang")
    both = _level(sketches, ["lang", "source"], "own")
    q = {(m, r): F.kll_sketch_get_quantile_double(F.col(m), F.lit(r)) for m in RATES for r in (0.5, 0.75)}
    bulk = sketches.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *[
        (q[m, 0.5] + 2 * TO_TENTH * (q[m, 0.75] - q[m, 0.5])).alias(f"{m}_bulk") for m in RATES])
    both = (both.join(langs, F.col("lang").eqNullSafe(F.col("__lang")))
            .join(bulk, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))))

    def pulled(own: Column, n: str, parent: Column) -> Column:
        weighed = (F.col(n) * own + prior_rows * parent) / (F.col(n) + prior_rows)
        return F.coalesce(weighed, own, parent)

    out = []
    for m in RATES:
        lang = pulled(F.col(f"{m}_lang"), "n_lang", of_corpus(m))
        fence = pulled(F.col(f"{m}_own"), "n_own", lang)
        out.append(F.when(fence.isNotNull(), F.least(F.greatest(fence, F.col(f"{m}_bulk")), F.lit(1.0))).alias(f"{m}_high"))
    for side in ("low", "high"):
        lang = pulled(F.col(f"{side}_lang"), "n_lang", of_corpus(side))
        out.append(pulled(F.col(f"{side}_own"), "n_own", lang).alias(f"{LENGTH}_{side}"))
    return shared_table(both.select("lang", "source", *out), "quality-fences")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per document: id, lang, source, measures, base_failed, failed (measure names) and kept."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                      F.col(text_col).alias("text"))
    measured = shared_table(_with_rates(text_measures(own)), "quality-measures")
    limits = fitted_fences(measured, prior_rows).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang"))
                           & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = [F.when(F.col(m) > F.col(f"{m}_high"), F.lit(m)) for m in RATES]
    failed.append(F.when((F.col(LENGTH) > F.col(f"{LENGTH}_high")) | (F.col(LENGTH) < F.col(f"{LENGTH}_low")), F.lit(LENGTH)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (joined.withColumn("base_failed", base)
            .withColumn("failed", F.array_compact(F.array(*failed)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
            .select(*measured.columns, "base_failed", "failed", "kept"))
