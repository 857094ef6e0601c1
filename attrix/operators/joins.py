"""Joins (J1-J4).  Strategy (broadcast vs sort-merge) is left to Catalyst/AQE,
which broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` -- a checked bound, not a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attrix.session import shared_table

JOIN_TYPES = ["inner", "left_outer", "right_outer", "full_outer", "left_semi", "left_anti"]


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on a key pair ``(left_key, right_key)``.

    J2: same name -> one key column in the result (``using`` join).
    J1: different names -> both key columns kept.
    J3: ``how`` is any Spark join type.
    """
    left_key, right_key = keys
    if left_key == right_key:
        return left.join(right, on=left_key, how=how)
    return left.join(right, left[left_key] == right[right_key], how=how)


def join_aggregate(left: DataFrame, aggregate: DataFrame, keys, how: str = "left_outer",
                   name: str = "aggregate") -> DataFrame:
    """Join an aggregate (one row a key) onto rows whose keys may be hot.

    An aggregate that is computed in the join's own stage pins that stage to its partitioning, and a hot key of
    the other side then lands in one task.  Written first, both sides of the join are plain
    exchanges: adaptive execution splits the partitions of a hot key, or broadcasts
    the table where its measured size allows.
    """
    return join_on_keys(left, shared_table(aggregate, name), keys, how)
