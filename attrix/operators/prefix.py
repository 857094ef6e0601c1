"""Bucketed running totals: a prefix sum that never puts a whole group in one task.

A running sum over ``Window.partitionBy(key).orderBy(t)`` sends every row of
a key to one task, so a key holding a third of the data serialises a third of
the job.  Here the ordered rows of a key are cut into buckets, which
:func:`ranged_running_totals` takes from a range partitioning:

1. running sums *within* each (key, bucket) -- a window over one bucket;
2. bucket totals -- a grouped aggregate with a map-side partial step;
3. per-key prefix of the bucket totals -- a window over at most
   ``#buckets`` rows per key (at most the number of ranges);
4. join 1 and 3 on (key, bucket) and add.

The bucket must be a non-null, non-decreasing function of the ordering
within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.session import shared_table, table_bytes

RANGE_BYTES = 32 << 20  # of the written, compressed rows


def running_totals(df: DataFrame, keys, bucket: str, order, values,
                   suffix: str = "_cum", group_totals: bool = False) -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows of the same ``keys`` that sort
    at or before the row (by ``bucket``, then ``order``), for each ``v``.

    ``order`` must break ties within a bucket, otherwise the split between
    tied rows is arbitrary.  With ``group_totals`` also add ``<v>_total``, the
    sum over the whole key group (carried on the small offsets table, so no
    extra pass or join over the big side).
    """
    keys, order, values = list(keys), list(order), list(values)
    part = keys + [bucket]
    w_in = (Window.partitionBy(*part).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = df.select("*", *[F.sum(v).over(w_in).alias(f"__in_{v}") for v in values])

    totals = df.groupBy(*part).agg(*[F.sum(v).alias(f"__bt_{v}") for v in values])
    # No keys (a global order): the offsets window sees one row per bucket,
    # a table whose size is fixed by the caller's bucket count.
    w_keys = Window.partitionBy(*keys) if keys else Window.partitionBy()
    w_before = w_keys.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offset_cols = [F.coalesce(F.sum(f"__bt_{v}").over(w_before), F.lit(0)).alias(f"__off_{v}")
                   for v in values]
    total_cols = ([F.sum(f"__bt_{v}").over(w_keys).alias(f"{v}_total") for v in values]
                  if group_totals else [])
    # key columns renamed: both sides descend from ``df``, so the names alone
    # would make an ambiguous self-join condition
    offsets = totals.select(*[F.col(c).alias(f"__k_{c}") for c in part], *offset_cols, *total_cols)

    # plain equi-join: ``within`` is already hash-partitioned on ``part`` by
    # its window, so only the small offsets side is shuffled
    cond = [F.col(c) == F.col(f"__k_{c}") for c in part]
    joined = within.join(offsets, cond, how="inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"__in_{v}") + F.col(f"__off_{v}")).alias(f"{v}{suffix}") for v in values],
        *[f"{v}_total" for v in values if group_totals],
    )


def ranged_running_totals(df: DataFrame, keys, order, values, suffix: str = "_cum",
                          group_totals: bool = False, ranges: int | None = None) -> DataFrame:
    """:func:`running_totals` over ranges cut from the data.

    The rows are range-partitioned by (keys, order) and written once with
    their range number, so a range holds about as many rows as any other,
    whatever the keys, bursts or ties: a hot key spreads over many ranges and
    small keys share one.  ``order`` must tell the rows of a key apart, or
    rows that tie on all of it stay in one range.

    The rows are written before they are cut: the range bounds come from a sample of that table, so what
    builds ``df`` runs once, and a range holds about ``RANGE_BYTES`` of it.  The number of ranges
    (given by ``ranges``, else by those bytes, the session's shuffle partitions at least, of which adaptive
    execution joins small ones) does not change the sums.
    """
    keys, order = list(keys), list(order)
    rows = shared_table(df, "ranges-in")
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes(rows) // RANGE_BYTES))
    cut = rows.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id())
    out = running_totals(shared_table(cut, "ranges"), keys, "__range", order, values, suffix=suffix,
                         group_totals=group_totals)
    return out.drop("__range")
