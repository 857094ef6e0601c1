"""Session helpers: a local session for tests/bench, and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans joins/partition counts at run
# time, splits skewed join partitions, and UTC keeps timestamps engine-neutral.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "attrix", driver_memory: str = "8g") -> SparkSession:
    """A local[N] session for tests and the bench (UI off, loopback only)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
    )
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session conf.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local default is only created for
    local-mode sessions (tests), never on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="attrix-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


def shared_table(df, name: str = "table"):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage in one computation, keeps column pruning for later reads,
    and survives lost executors, as the folder is shared storage.  The files
    belong to the innermost :func:`owned_tables` block and go with it; outside of any, they
    are removed by :func:`release_shared_tables`, at the latest when Python exits.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str = "folder") -> str:
    """A new path in the shared checkpoint folder, owned as :func:`shared_table`'s files are."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _own(path)
    return path


class BucketedTable:
    """A table in the shared folder, bucketed by a column: grouping or joining by it reads what was added without an exchange."""

    def __init__(self, spark: SparkSession, name: str, column: str):
        self.spark, self.name, self.path, self.column = spark, f"attrix_{uuid.uuid4().hex}", shared_folder(spark, name), column
        self.number = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, df) -> None:
        (df.write.format("parquet").option("path", self.path).mode("append")
         .bucketBy(self.number, self.column).saveAsTable(self.name))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def last_rows(self) -> DataFrame:
        """The rows, when none will be added: the catalogue's entry goes, the files stay with their owner."""
        rows = self.rows()
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


def table_bytes(df) -> int:
    """Bytes that a frame will scan by Spark's own estimate (a table's file sizes); 0 where it knows none."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else 0


_written: list[str] = []
_owner: ContextVar[list[str]] = ContextVar("attrix_tables", default=_written)


def _own(path: str) -> None:
    if not _written:
        atexit.register(_release_at_exit)
    _owner.get().append(path)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`shared_table` writes inside belong to this block and are removed at its end."""
    own: list[str] = []
    token = _owner.set(own)
    try:
        yield
    finally:
        _owner.reset(token)
        _remove(spark, own)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files at their end; what they write is read from its files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def settled(spark: SparkSession, build, name: str = "result"):
    """The frame that ``build()`` returns, written as one table of the caller's; what it wrote on the way is removed."""
    path = shared_folder(spark, name)
    with owned_tables(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> int:
    hadoop = spark._jsc.hadoopConfiguration()
    n = len(paths)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def release_shared_tables(spark: SparkSession) -> int:
    """Remove the tables that no block owns; frames that read them are spent.  Returns their number."""
    return _remove(spark, _written)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _written and spark is not None and spark.sparkContext._jsc is not None:
        release_shared_tables(spark)
