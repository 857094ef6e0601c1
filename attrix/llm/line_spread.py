"""Line deduplication by the number of distinct sites that use a line.

Every line with a word is hashed (128 bits).  One aggregation gives each hash
a HyperLogLog sketch of its sites, merged from partial sketches of the map
side, and the smallest id of a document that has it.  Lines whose estimate is
clearly over or under ``min_sites`` are settled by it; the few whose estimate lies within
``band`` standard errors (and one site at least) get an exact distinct count.
Cross-site lines stay in their first document, so content that was merely
copied whole is not lost, and go from all others.

A line on a third of all documents is one row after each task's partial
aggregate; the last joins meet written tables, so adaptive execution can
split a hot line or site.  What is cut is known by place, so a document's lines are cut in
one pass over them, however many there are.

Edge cases: null text has no lines; lines without a word are neither counted
nor removed; a null site is a site of its own; a document with a null id is
never a line's first document; an id may name several texts, each is cut by itself; rows that repeat id and text lose
the same lines; a text of very many lines costs time in proportion; an empty
table gives an empty result; extra columns stay as they are, but for ``n_lines`` and ``n_removed``, which the counts
replace where they are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import shared_table

MIN_SITES = 10


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = 10, band: float = 4.0) -> DataFrame:
    """Lines on ``min_sites`` sites or more: (hash, first_id); ``lines`` has (hash, site, doc_id)."""
    found = shared_table(
        lines.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_id"),
                                  F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("hash", "first_id", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    margin = max(1.0, band * 1.04 / math.sqrt(2 ** lg_k) * min_sites)
    clear = found.filter(F.col("sites") > min_sites + margin).select("hash", "first_id")
    near = found.filter(F.col("sites").between(min_sites - margin, min_sites + margin))
    exact = (lines.join(near.select("hash", "first_id"), "hash").select("hash", "first_id", "site").distinct()
             .groupBy("hash", "first_id").count().filter(F.col("count") >= min_sites).select("hash", "first_id"))
    return clear.unionByName(exact)


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                      site_col: str = "source", counts: bool = True) -> DataFrame:
    """``docs`` with cross-site lines cut from the text and, with ``counts``, n_lines and n_removed (lines with a word)."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))  # null is not the empty string
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), site.alias("site"),
                       F.posexplode(_lines(F.col(text_col))).alias("place", "line"))
    lines = shared_table(rows.filter(_has_word(F.col("line")))
                         .select("doc_id", "text_hash", "site", "place", line_hash(F.col("line")).alias("hash")), "lines")
    spread = shared_table(spread_lines(lines, min_sites), "spread-lines")
    cut = (lines.join(spread, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
           .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
           .agg(F.collect_set("place").alias("__cut")))
    cut = shared_table(cut, "cut-lines")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    split = docs.join(cut.hint("merge"), same, "left")  # alike at every size
    split = split.withColumn("__lines", _lines(F.col(text_col)))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__cut"))
    kept = F.transform(places, lambda k: F.get(F.col("__lines"), k))
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    found = {"n_lines": F.size(F.filter("__lines", _has_word)).cast("long"),
             "n_removed": F.coalesce(F.size("__cut"), F.lit(0)).cast("long")} if counts else {}
    others = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in found]
    return split.select(*others, *[n.alias(name) for name, n in found.items()])
