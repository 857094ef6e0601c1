"""Exact deduplication with a heavy-hitter split.

Digests of whole texts are written once.  Misra-Gries counters
(``DataFrame.freqItems``, which keeps at most ``1 / support`` counters a task
and never misses a digest with more than that share of the rows) name the
candidates; their exact counts are verified, and the winners, at most
``1 / support`` rows, are broadcast.  All copies of a winner are then settled on
the map side; only the remaining digests are shuffled: their groups are aggregated, with a map-side step, and joined back by digest.

Edge cases: a null text counts as empty; a null id is older than any other id;
rows that repeat both id and text count separately and exactly one of them
stays (which one makes no difference: they are equal); an empty table gives
an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import shared_table

SUPPORT = 1 / 2000


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests on more than ``support`` of the rows: (digest, heavy_id, heavy_size), and the survivor's row
    number where ``digests`` has a column ``row``.

    Candidates come from Misra-Gries counters; exact counts verify them, so at
    most ``1 / support`` rows remain.
    """
    named = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    total = digests.count()
    counted = (digests.join(F.broadcast(named), "digest", "left_semi")
               .groupBy("digest").agg(F.max("doc_id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_size"),
                                      *([_survivor().alias("heavy_row")] if "row" in digests.columns else [])))
    return counted.filter((F.col("heavy_size") > 1) & (F.col("heavy_size") > F.lit(support * total)))


def _survivor() -> Column:
    """Row number of the row that stays: the largest id (null is least), and of rows that repeat it any one."""
    return F.max_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id", "row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    digests = shared_table(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"),
                    F.monotonically_increasing_id().alias("row")), "digests")
    winners = F.broadcast(shared_table(frequent_digests(digests, support), "frequent-digests"))
    tagged = digests.join(winners, "digest", "left")

    settled = tagged.filter("heavy_size is not null").select(
        "doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"),
        (F.col("row") == F.col("heavy_row")).alias("kept"), F.col("digest").alias("text_sha256"))

    rest = tagged.filter("heavy_size is null").select("doc_id", "digest", "row")
    groups = (rest.groupBy(F.col("digest").alias("text_sha256"))
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), _survivor().alias("keep_row")))
    groups = shared_table(groups, "digest-groups")
    rest = rest.join(groups, F.col("digest") == F.col("text_sha256")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return settled.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns: one row per text.

    Of rows that repeat both id and text one stays, that with the smallest hash of all its columns.
    """
    kept = exact_duplicates(docs, id_col, text_col, support).filter("kept")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    stay = docs.join(kept, same, "left_semi").withColumn("__digest", digest)
    # few rows are left of each text: those that repeat the id that stays
    return (stay.withColumn("__row", F.struct(F.xxhash64(*docs.columns).alias("order"), F.struct(*docs.columns).alias("row")))
            .groupBy("__digest").agg(F.min_by("__row.row", "__row.order").alias("row")).select("row.*"))
