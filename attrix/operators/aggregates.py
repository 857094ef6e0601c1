"""Aggregations (A1-A4, A8).  All are grouped aggregates with a map-side
partial step, so a customer holding a large share of the rows is reduced
before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    """A1 as a one-row frame (lazy; the caller decides when to act)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def count_per_key(df: DataFrame, key: str, item: str, alias: str,
                  assume_unique: bool = True) -> DataFrame:
    """A2/A4: number of distinct ``item`` per ``key``.

    Cleaned frames are deduplicated on ``item``, so a plain count equals the
    distinct count and saves the extra (key, item) shuffle that
    ``count(DISTINCT)`` plans.  Pass ``assume_unique=False`` otherwise.
    """
    agg = F.count(item) if assume_unique else F.count_distinct(item)
    return df.groupBy(key).agg(agg.alias(alias))


def sum_per_key(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """A3: a sum per key (nulls ignored; all-null groups give null).

    Summed as decimals with two places, so the order of the rows cannot change it.
    """
    return df.groupBy(key).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias(alias))


def complaints_per_customer(ticket: DataFrame) -> DataFrame:
    return count_per_key(ticket, "csi_ticket_customer_finance_ref", "csi_ticket_sys_id",
                         "number_complaints")


def crs_score_per_customer(assessment: DataFrame) -> DataFrame:
    return sum_per_key(assessment, "asmt_customer_finance_ref", "asmt_result_actual_value",
                       "crs_score")


def incidents_per_customer(incident: DataFrame) -> DataFrame:
    return count_per_key(incident, "incident_customer_finance_ref", "incident_number",
                         "number_incidents")


def class_balance(df: DataFrame, label: str = "cancelled") -> DataFrame:
    """Total, positive and negative rows in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.col(label) == 1).alias("positive_rows"),
                  F.count_if(F.col(label) == 0).alias("negative_rows"))


WORD_BITS = 6  # a bitmap is one long: 64 numbers


def distinct_bitmaps(df: DataFrame, keys, item: str) -> DataFrame:
    """A2/A4 without assuming unique rows: exact bitmaps of the distinct ``item`` numbers of each key.

    One row per key and block of 64 numbers, its bitmap a long, built with a map-side step.  A long is a fixed
    field of the aggregate's row, so the aggregate spills as a sum does and one task's memory stays bounded; scattered numbers
    cost one row each at most, never more than the rows read.  Bitmaps merge by OR, so counts roll up from
    days to months, or from batches to a total, without reading the items again.  ``item`` must be a whole number.
    """
    number = F.col(item).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
    return (df.where(number.isNotNull())
            .groupBy(*keys, F.shiftright(number, WORD_BITS).alias("_block"))
            .agg(F.bit_or(bit).alias("_bitmap")))


def merge_bitmaps(bitmaps: DataFrame, keys) -> DataFrame:
    """Bitmaps of coarser keys (or of several batches): the union of the items, block by block."""
    return bitmaps.groupBy(*keys, "_block").agg(F.bit_or("_bitmap").alias("_bitmap"))


def count_bitmaps(bitmaps: DataFrame, keys, alias: str) -> DataFrame:
    """Distinct items of each key."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("_bitmap").cast("bigint")).alias(alias))
