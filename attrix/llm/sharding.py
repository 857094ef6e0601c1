"""Jump consistent hashing: stable keys to shards, without a ring table.

A shard follows from the key and the number of shards alone.  When one shard
is added, every row either stays or moves into the new shard, and about
``1 / (n + 1)`` of the rows move.

Slots number the rows of a shard from 0 without gaps.  A shard may hold a
24th of 100 TB, so no shard is sorted as a whole: rows are cut into hash
buckets within their shard, numbered within the bucket, and shifted by the
bucket's offset, a running total over one row per (shard, bucket).  The number
of buckets follows the row count.

Edge cases: a null key hashes as a fixed constant; null text has 0 bytes and
the checksum of the empty string; repeated rows get slots of their own; an
empty table gives an empty result.  Only the key and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attrix.llm.common import shared_table

# Fixed values of the published jump consistent hash (its 64-bit generator).
JUMP_MULTIPLIER = 2862933555777941757
ROWS_PER_BUCKET = 200_000


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys to 0 .. shards - 1, over whole arrays."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    moving = np.ones(len(state), bool)
    while moving.any():
        shard[moving] = jump[moving]
        state[moving] = state[moving] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[moving] = ((shard[moving] + 1) * (2147483648.0 / draw)).astype(np.int64)
        moving &= jump < shards
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of ``jump_shards`` over 64-bit integer keys."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_shards(keys.to_numpy(np.int64), shards))

    return shard_of(key)


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; ``grown_shard`` is the shard
    with one more shard.  The key is a hash of the id, so that consecutive ids
    spread evenly.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"))
    rows = shared_table(sized.withColumns({"shard": jump_shard(F.col("key"), shards),
                                           "grown_shard": jump_shard(F.col("key"), shards + 1)}), "shards")
    buckets = max(1, -(-rows.count() // (shards * rows_per_bucket)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(buckets)).cast("int"))

    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") + F.col("offset")).alias("slot"), "grown_shard")
