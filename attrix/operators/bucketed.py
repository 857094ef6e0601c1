"""Tables stored by key, so that later joins and groupings on it read them without an exchange.

Several tables are stored together: the same number of buckets of the same key, each bucket one sorted
file.  A bucket is one task for every later query, and no adaptive execution can split it.
So keys that are frequent in any of the tables are kept apart: Misra-Gries counters name at most
``1 / support`` candidates a table, exact counts verify them, and their rows go to
a plain table beside the buckets.  Queries treat those few keys by map-side aggregation and a broadcast of at
most ``1 / support`` rows a table; all other keys meet in their buckets.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import shared_folder, shared_table, table_bytes

SUPPORT = 1 / 1000
BUCKET_BYTES = 64 << 20


def frequent_keys(df: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """Keys on more than ``support`` of the rows: one column ``key``, at most ``1 / support`` rows."""
    named = df.filter(F.col(key).isNotNull()).freqItems([key], support).select(F.explode(f"{key}_freqItems").alias("key"))
    least = support * df.count()
    counted = df.join(F.broadcast(named), F.col(key) == F.col("key"), "left_semi").groupBy(F.col(key).alias("key")).count()
    return counted.filter(F.col("count") > F.lit(least)).select("key")


class BucketedTables:
    """Tables written together by a common key; see :meth:`spread` and :meth:`hot`."""

    def __init__(self, spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], support: float = SUPPORT,
                 buckets: int | None = None):
        """``tables``: name -> (rows, key column).  ``buckets`` follows the largest table's bytes unless given."""
        self.spark, self.keys = spark, {name: key for name, (_, key) in tables.items()}
        written = {name: shared_table(df, f"bucketing-{name}") for name, (df, _) in tables.items()}
        hot = reduce(DataFrame.unionByName, [frequent_keys(written[name], key, support) for name, key in self.keys.items()])
        self.hot_keys = shared_table(hot.distinct(), "hot-keys")
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets or max(least, -(-max(map(table_bytes, written.values())) // BUCKET_BYTES))
        self.names, self._hot = {}, {}
        for name, key in self.keys.items():
            is_hot = F.col(key) == F.col("key")
            self._hot[name] = shared_table(written[name].join(F.broadcast(self.hot_keys), is_hot, "left_semi"), f"hot-{name}")
            rest = written[name].join(F.broadcast(self.hot_keys), is_hot, "left_anti")
            self.names[name] = f"attrix_{name}_{uuid.uuid4().hex}"
            (rest.repartition(self.buckets, key).write.format("parquet").option("path", shared_folder(spark, f"buckets-{name}"))
             .bucketBy(self.buckets, key).sortBy(key).saveAsTable(self.names[name]))

    def spread(self, name: str) -> DataFrame:
        """Rows of all keys that are not hot, read by bucket."""
        return self.spark.table(self.names[name])

    def hot(self, name: str) -> DataFrame:
        """Rows of the hot keys."""
        return self._hot[name]

    def join_aggregate(self, left: str, right: str, aggregate, how: str = "left_outer") -> DataFrame:
        """``left`` joined with ``aggregate(rows of right, its key)``, one row a key.

        Spread keys are grouped and joined in their buckets; hot keys are aggregated with a map-side step and
        broadcast (one row a hot key).
        """
        l_key, r_key = self.keys[left], self.keys[right]

        def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
            table = table.withColumnRenamed(r_key, "__key")
            return rows.join(table, F.col(l_key) == F.col("__key"), how).drop("__key")

        spread = joined(self.spread(left), aggregate(self.spread(right), r_key))
        hot = joined(self.hot(left), F.broadcast(aggregate(self.hot(right), r_key)))
        return spread.unionByName(hot)

    def drop(self) -> None:
        """Forget the tables; their files go with their owner."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
