"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, as a table read back from Parquet,
and its decisions take effect: toxic documents go, cross-site lines go, one
document of each group of near duplicates stays, sources are mixed to their
target weights (a document taken twice is two rows), and the mix is packed
into sequences.  All stages but the last return the columns of ``documents``.

Edge cases, in every stage: null and empty texts are kept as documents without
lines, words or links (the last stage gives them their end token alone); null ids are never a
first or a copy; ids may repeat, with the same text or another; ties are broken by id, then by hash; very long texts
are read whole; an empty table gives an empty table; columns beyond those of
``documents`` pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import line_spread, mixing, ngram_join, packing, queries, toxicity
from attrix.llm.common import load, shared_table

# Near duplicates share 80% of their 5-word shingles; op8's contract (4 words, 85%) binds that query only.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, queries.toxicity_labels(spark, sf_dir))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows and other columns; ``n_chars`` follows the text that is left."""
    cut = line_spread.drop_spread_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, once; documents without an id or without words stay.

    An id may name several texts: each is judged by itself, and of a component's texts of one id that with the smallest
    hash stays.  Rows that repeat id and text are one document.  Who stays is settled on ids and
    hashes; the texts are moved once, to meet the decision.
    """
    groups = ngram_join.similar_documents(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    stays = (groups.filter("component is not null").groupBy("component")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*"))
    stays = stays.unionByName(groups.filter("doc_id is not null and component is null").select("doc_id", "text_hash")).distinct()
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__t"), F.xxhash64(*docs.columns).alias("__r"))
    rows = (rows.join(stays, (F.col("__d") == F.col("__id")) & (F.col("__t") == F.col("__hash")))
            .groupBy("__id", "__hash").agg(F.min("__r").alias("__row"), F.count(F.lit(1)).alias("__n")))
    rows = shared_table(rows, "near-duplicates-stay").hint("merge")
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")) & (F.xxhash64(*docs.columns) == F.col("__row"))
    kept = docs.filter("doc_id is not null").join(rows, same)
    # rows that are equal in every column are left only where id and text repeat
    once, repeated = (kept.filter(c).select(*docs.columns) for c in ("__n = 1", "__n > 1"))
    return once.unionByName(repeated.dropDuplicates()).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("mixture", mix_sources),
    ("packing", pack),
]

# SQL cannot express the trained classifier, the draws and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
