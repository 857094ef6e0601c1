"""Cleaning that keeps up with arriving batches.

The survivor of a key is the smallest row by its other columns, so survivors merge: the survivor of old and new rows is
the smaller of the old survivor and the new rows'.  A store keeps the survivors in buckets of
keys; a batch reads and rewrites only the buckets that its keys fall into.

Rewritten buckets go to a folder of their own and become the store's by one replacement of a small manifest (bucket -> folder).
So a reader sees the store before a batch or after it, and a batch that was interrupted is as if
it had not begun.  (Overwriting partitions in place deletes each before it renames its successor; a crash in between loses it.)

Filters that come after deduplication are applied when the store is read, as a
later batch may still bring a smaller survivor.

Every survivor is written with its key's row counts, so the report reads two narrow columns of what was
written and nothing of the source.  (``DataFrame.observe`` would save that too, but once a session has made an ``Observation``,
Spark 4.1 can no longer serialise a logistic or forest model that holds its training summary, and a stage that runs again
after an executor was lost is observed twice.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attrix.operators.clean import CLEAN_SPECS, counted_survivors, drop_duplicate_rows, stage_counts, stage_report
from attrix.session import owned_tables, shared_table
from attrix.sources import storage

BUCKET = "_bucket"
BUCKETS = 64


def key_bucket(keys, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class CleanStore:
    """Survivors of one source view under ``path``, in ``buckets`` folders by key.

    The number of buckets is fixed when the store is made (a bucket is what one batch rewrites of it,
    so it follows the store's expected size) and read back from then on.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, view: str, buckets: int = BUCKETS):
        self.spark, self.path, self.view, self.spec = spark, path.rstrip("/"), view, CLEAN_SPECS[view]
        self.manifest = f"{self.path}/manifest.json"
        if not storage.exists(spark, self.manifest):
            self._publish({"view": view, "buckets": buckets, "schema": None, "folders": {}})
        self.buckets = self._state()["buckets"]

    def _state(self) -> dict:
        return json.loads(storage.read_text(self.spark, self.manifest))

    def _publish(self, state: dict) -> None:
        storage.write_text(self.spark, self.manifest, json.dumps(state, sort_keys=True))

    def _read(self, state: dict, buckets=None) -> DataFrame:
        """The survivors of some (or all) buckets; no other bucket's files are listed."""
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in state["folders"].items()
                 if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def survivors(self) -> DataFrame | None:
        """C1 over all batches so far, before the view's filter; None before the first batch."""
        state = self._state()
        return None if state["schema"] is None else self._read(state)

    def clean(self) -> DataFrame | None:
        """C2 over all batches so far: the survivors that pass the view's filter."""
        rows = self.survivors()
        return rows if rows is None or self.spec.post_filter is None else rows.filter(self.spec.post_filter())

    def merge(self, batch: DataFrame) -> dict[str, int]:
        """Add a batch.  Returns its counts: rows loaded, rows without nulls, and buckets rewritten."""
        with owned_tables(self.spark):
            return self._merge(batch)

    def _merge(self, batch: DataFrame) -> dict[str, int]:
        keys, state = self.spec.key_columns, self._state()
        # one pass over the batch: its own survivors, and its counts
        counted = shared_table(counted_survivors(batch, self.spec), "clean-batch")
        seen = counted.agg(*[n.alias(name) for name, n in stage_counts(self.spec).items()]).first()
        fresh = counted.filter("_present > 0").select(*batch.columns)
        fresh = fresh.withColumn(BUCKET, key_bucket(keys, self.buckets))
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # as many as there are buckets at most
        merged = fresh.drop(BUCKET)
        if state["schema"] is not None:
            merged = drop_duplicate_rows(self._read(state, set(touched)).select(*batch.columns).unionByName(merged), keys)
        folder = f"rows-{uuid.uuid4().hex}"
        if touched:
            # rows of a bucket lie together; adaptive execution splits a bucket that is large
            (merged.withColumn(BUCKET, key_bucket(keys, self.buckets)).hint("rebalance", BUCKET)
             .sortWithinPartitions(BUCKET, *keys).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}"))
        replaced = {f for b, f in state["folders"].items() if int(b) in touched}
        state["folders"] |= {str(b): folder for b in touched}
        state["schema"] = json.loads(batch.schema.json())
        self._publish(state)
        for f in replaced - set(state["folders"].values()):
            storage.delete(self.spark, f"{self.path}/{f}")  # no bucket is read from there any more
        return {"loaded": seen["loaded"] or 0, "not_null": seen["not_null"] or 0, "rewritten": len(touched)}


def clean_and_count(df: DataFrame, view: str, path: str) -> tuple[DataFrame, DataFrame]:
    """C2 and C3 in one pass over the source: write the survivors with their counts; the cleaned view and the report read that.

    The report has the rows of :func:`~attrix.operators.clean.clean_report`; its scan reads the counts alone (and what the
    view's filter needs).  The cleaned view's filters are pushed into its scan.
    """
    spec = CLEAN_SPECS[view]
    counted_survivors(df, spec).write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    cleaned = written.filter("_present > 0").select(*df.columns)
    if spec.post_filter is not None:
        cleaned = cleaned.filter(spec.post_filter())
    return cleaned, stage_report(written, view)
