"""Load a SQL query from a database as a partitioned JDBC read.

The source hands Spark a derived table ``(select ...) as alias``.  A single
JDBC partition would pull the whole view through one task, so the caller
names a split column with its bounds, or one predicate a partition; reading in
one task must be asked for.  Credentials are passed in by the caller
(``properties``); token lookup belongs to the deployment, not this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def as_derived_table(sql_query: str, alias: str) -> str:
    """Wrap a query so JDBC can use it as a table: ``(query) as alias``."""
    query = sql_query.strip()
    if query.startswith("(") and query.rstrip().lower().endswith(f") as {alias.lower()}"):
        return query
    return f"({query}) as {alias}"


def read_jdbc_query(spark: SparkSession, url: str, sql_query: str, properties: dict,
                    alias: str = "src", partition_column: str | None = None,
                    lower_bound=None, upper_bound=None, num_partitions: int | None = None,
                    predicates: list[str] | None = None, single_partition: bool = False,
                    fetch_size: int = 10000) -> DataFrame:
    """Read a query by ranges of a column (numeric, date or timestamp bounds), by
    one predicate a partition, or, only when ``single_partition`` says so, in one task.

    Timestamps arrive without time zone, as the date operators expect them.
    """
    ways = (partition_column is not None) + (predicates is not None) + single_partition
    if ways != 1:
        raise ValueError("give partition_column with bounds, or predicates, or single_partition=True")
    if partition_column is not None and None in (lower_bound, upper_bound, num_partitions):
        raise ValueError("partitioned JDBC reads need lower_bound, upper_bound and num_partitions")
    if predicates is not None and not predicates:
        raise ValueError("predicates must not be empty")
    table = as_derived_table(sql_query, alias)
    props = {"fetchsize": str(fetch_size), "preferTimestampNTZ": "true", **properties}
    if predicates is not None:
        return spark.read.jdbc(url=url, table=table, predicates=predicates, properties=props)
    if single_partition:
        return spark.read.jdbc(url=url, table=table, properties=props)
    options = {"url": url, "dbtable": table, "partitionColumn": partition_column, "lowerBound": str(lower_bound),
               "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}
    return spark.read.format("jdbc").options(**props, **options).load()
