"""Cleaning operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.functions.expressions import SURVEY_METRIC_TYPE, TEST_ORDER_REASON


def drop_null_rows(df: DataFrame, columns) -> DataFrame:
    """Drop rows with a null in any listed column."""
    return df.dropna(how="any", subset=list(columns))


def drop_duplicate_rows(df: DataFrame, keys) -> DataFrame:
    """One row per key; the survivor is the smallest row by the other columns.

    ``dropDuplicates`` keeps an arbitrary row.  Here the survivor is
    ``min(struct(other columns))`` (column order, nulls first), so it is the
    same on every run and partitioning.  It is a grouped aggregate with a
    map-side partial step: a key duplicated millions of times is collapsed
    before the shuffle instead of landing whole in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    return (df.groupBy(*keys)
              .agg(F.min(F.struct(*rest)).alias("_survivor"))
              .select(*keys, "_survivor.*")
              .select(*df.columns))


def filter_not_equals(df: DataFrame, column: str, value, keep_null: bool = False) -> DataFrame:
    """``!=`` also rejects nulls; ``keep_null`` keeps them instead."""
    cond = F.col(column) != F.lit(value)
    if keep_null:
        cond = cond | F.col(column).isNull()
    return df.filter(cond)


def valid_priority(column: str = "incident_priority", low: int = 1, high: int = 5) -> Column:
    """P13 predicate: priority is an integer in [low, high] (fractions and non-numbers are invalid)."""
    number = F.col(column).try_cast("double")
    return number.between(low, high) & (number == F.floor(number))


def filter_valid_priority(df: DataFrame, column: str = "incident_priority",
                          low: int = 1, high: int = 5) -> DataFrame:
    return df.filter(valid_priority(column, low, high))


@dataclass(frozen=True)
class CleanSpec:
    """How one source view is cleaned: null-drop, dedupe, then an optional filter."""
    null_columns: list
    key_columns: list
    post_filter: object = None          # callable Column factory or None
    post_filter_name: str = field(default="filtered")


# ---------------------------------------------------------------------------
# The cleaning rules of each source view.
# ---------------------------------------------------------------------------
CLEAN_SPECS = {
    "incident": CleanSpec(["incident_number", "incident_created", "incident_customer_finance_ref"],
                          ["incident_number"]),
    "ticket": CleanSpec(["csi_ticket_customer_finance_ref"], ["csi_ticket_sys_id"]),
    "assessment": CleanSpec(["asmt_customer_finance_ref"], ["asmt_result_sys_id"],
                            lambda: F.col("asmt_metric_type") == F.lit(SURVEY_METRIC_TYPE)),
    "orderatom": CleanSpec(["order_orderid", "order_orderdate", "customer_finance_ref",
                            "orderatom_orderatomid"], ["orderatom_orderatomid"],
                           lambda: F.col("orderatom_cancelation_reason") != F.lit(TEST_ORDER_REASON)),
}


def clean(df: DataFrame, null_columns, key_columns) -> DataFrame:
    """Null-drop then dedupe (no hidden row-count actions)."""
    return drop_duplicate_rows(drop_null_rows(df, null_columns), key_columns)


def clean_view(df: DataFrame, view: str, apply_filter: bool = True) -> DataFrame:
    """Clean a source view by its spec; the filter runs after dedupe, as specified."""
    spec = CLEAN_SPECS[view]
    out = clean(df, spec.null_columns, spec.key_columns)
    if apply_filter and spec.post_filter is not None:
        out = out.filter(spec.post_filter())
    return out


def counted_survivors(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """C1 with its counts: one row per key with the key's rows (``_loaded``), those without nulls (``_present``)
    and, if there are any, the survivor's columns (else nulls).  One grouped aggregate with a map-side step."""
    keys = list(spec.key_columns)
    present = F.lit(True)
    for c in spec.null_columns:
        present = present & F.col(c).isNotNull()
    rest = [c for c in df.columns if c not in keys]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_loaded"), F.count_if(present).alias("_present"),
                                    F.min(F.when(present, F.struct(*rest))).alias("_survivor"))
    return per_key.select("_loaded", "_present", *keys, "_survivor.*")


def clean_report(df: DataFrame, view: str) -> DataFrame:
    """Rows per cleaning stage as a long table (view, stage, row_count).

    One scan and one grouped aggregate: each key carries its rows, its rows
    without nulls and its survivor, and a sum over the keys gives every stage.
    """
    return stage_report(counted_survivors(df, CLEAN_SPECS[view]), view)


def stage_report(survivors: DataFrame, view: str) -> DataFrame:
    """C3 from counted survivors, computed or written."""
    stages = stage_counts(CLEAN_SPECS[view])
    counted = survivors.agg(*[F.coalesce(n, F.lit(0)).alias(name) for name, n in stages.items()])
    stack = ", ".join(f"'{name}', `{name}`" for name in stages)
    return counted.select(F.lit(view).alias("view_name"), F.expr(f"stack({len(stages)}, {stack}) AS (stage, row_count)"))


def stage_counts(spec: CleanSpec) -> dict[str, Column]:
    """The aggregates of :func:`counted_survivors` that give the rows of each cleaning stage, in order."""
    stages = {"loaded": F.sum("_loaded"), "not_null": F.sum("_present"), "deduplicated": F.count_if(F.col("_present") > 0)}
    if spec.post_filter is not None:
        stages[spec.post_filter_name] = F.count_if((F.col("_present") > 0) & spec.post_filter())
    return stages
