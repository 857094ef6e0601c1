"""Incident counts per order atom by priority and by days after installation
(A5-A7, J5-J7, P14) -- without joining order atoms to incidents pair by pair.

The straightforward plan joins every order atom of a customer to every
incident of that customer, then filters and counts.  That emits all pairs
inside a customer: a customer with a third of the orders and a third of the
incidents makes the join quadratic in one task.  Instead:

* a windowed count is a difference of two prefix counts,
  ``#{created <= upper} - #{created < installed}``, read at *query rows*.
  Incidents are pre-aggregated per (customer, timestamp); each distinct
  (customer, install date) gives one query row per bound, carrying its key;
  both are merged in one ordered stream and summed with
  :func:`ranged_running_totals`, which cuts the stream into ranges of like
  size, so a hot customer, a burst or a day of many installations spreads over many tasks;
* counts with no date condition are the per-customer totals of the same pass,
  carried on its small offsets table;
* the counts are written before they are joined to the order atoms, so both join sides are plain
  exchanges and adaptive execution splits a hot customer or (customer, day).

Results equal the pairwise definition (``count(DISTINCT incident_number)`` on
deduplicated incidents, null when no incident matches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.functions.expressions import window_upper_bound
from attrix.operators.prefix import ranged_running_totals
from attrix.session import shared_table

# ---------------------------------------------------------------------------
# Priorities and day windows of the incident count columns
# (0 = no window).
# ---------------------------------------------------------------------------
PRIORITIES = (1, 2, 3, 4, 5)
WINDOW_DAYS = (0, 50, 100, 200)

_BEFORE, _INCIDENT, _AT_OR_BEFORE = 0, 1, 2     # tie order at equal timestamps
# Order atoms without an install date are placed at the earliest timestamp:
# their windows then hold no incidents (null counts) while the no-window
# totals stay right, and every join stays a plain equi-join.
_NO_INSTALL_DATE = "0001-01-01 00:00:00"
# Join key of order atoms without a cancel date (never compared with incidents).
_NO_CANCEL_DATE = "9999-12-31 00:00:00"


def _install_key(installed: str):
    return F.coalesce(F.col(installed), F.lit(_NO_INSTALL_DATE).cast("timestamp_ntz"))


def priority_count_column(priority: int, days: int) -> str:
    """P5: ``number_p{p}_incidents`` or ``number_p{p}_incidents_{d}_days``."""
    base = f"number_p{priority}_incidents"
    return base if days == 0 else f"{base}_{days}_days"


def priority_count_columns(priorities=PRIORITIES, windows=WINDOW_DAYS) -> list[str]:
    return [priority_count_column(p, d) for p in priorities for d in windows]


def _count_names(priorities) -> list[str]:
    return ["_n_all"] + [f"_n_p{p}" for p in priorities]


def incident_prefix_counts(incidents: DataFrame, query_rows: DataFrame, priorities=PRIORITIES,
                           customer: str = "incident_customer_finance_ref",
                           created: str = "incident_created", priority: str = "incident_priority",
                           group_totals: bool = False, include_all: bool = True,
                           ranges: int | None = None) -> DataFrame:
    """Prefix counts of incidents at query rows.

    ``query_rows`` has ``_cust``, ``_t``, ``_tie`` (0: count ``created < _t``,
    2: count ``created <= _t``) and any columns to carry along.  Returns the
    query rows with ``_n_all`` / ``_n_p{p}`` (incidents of ``_cust`` before the
    point, any / each priority) and, with ``group_totals``, ``_n_*_total``
    (all incidents of ``_cust``).  A null ``_t`` counts 0.  ``incidents`` must
    hold one row per incident (cleaned).
    """
    names = _count_names(priorities) if include_all else [f"_n_p{p}" for p in priorities]
    carried = [c for c in query_rows.columns if c not in ("_cust", "_t", "_tie")]
    types = {f.name: f.dataType for f in query_rows.schema.fields}
    incident_rows = (
        incidents.where(F.col(created).isNotNull())
        .groupBy(F.col(customer).alias("_cust"), F.col(created).alias("_t"))
        .agg(*([F.count(F.lit(1)).alias("_n_all")] if include_all else []),
             *[F.count_if(F.col(priority) == p).alias(f"_n_p{p}") for p in priorities])
        .select("_cust", "_t", F.lit(_INCIDENT).alias("_tie"),
                *[F.lit(None).cast(types[c]).alias(c) for c in carried], *names)
    )
    point_rows = query_rows.select("_cust", "_t", "_tie", *carried,
                                   *[F.lit(0).cast("bigint").alias(n) for n in names])
    # the carried columns tell query rows at one time apart, so ranges may part them
    summed = ranged_running_totals(incident_rows.unionByName(point_rows), ["_cust"], ["_t", "_tie", *carried], names,
                                   suffix="_cum", group_totals=group_totals, ranges=ranges)
    return summed.where(F.col("_tie") != _INCIDENT).select(
        "_cust", "_t", "_tie", *carried, *[F.col(f"{n}_cum").alias(n) for n in names],
        *[f"{n}_total" for n in names if group_totals])


def _nullif_zero(c):
    return F.when(c != 0, c)


def priority_totals_per_customer(incidents: DataFrame, priorities=PRIORITIES,
                                 customer: str = "incident_customer_finance_ref",
                                 priority: str = "incident_priority") -> DataFrame:
    """A5: incidents of each priority per customer (no date window)."""
    return incidents.groupBy(F.col(customer).alias("_cust")).agg(
        *[F.count_if(F.col(priority) == p).alias(priority_count_column(p, 0)) for p in priorities])


def priority_window_counts(orderatoms: DataFrame, incidents: DataFrame, priorities=PRIORITIES,
                           windows=(50, 100, 200), customer: str = "customer_finance_ref",
                           installed: str = "orderatom_dateinstalled",
                           ranges: int | None = None) -> DataFrame:
    """Per distinct (customer, installed): incidents with
    ``installed <= created <= date_add(installed, n)`` for each priority and
    n > 0, and (when 0 is among ``windows``) all incidents per priority.

    Each distinct (customer, installed) becomes one query row per bound; the
    rows carry their key through the prefix sum, so no join back is needed.
    Returns ``_cust``, ``_d`` and one column per (priority, window); zero
    counts are 0 here (callers null them to mirror a left join).
    """
    positive = [n for n in windows if n > 0]
    with_total = 0 in windows
    keys = (orderatoms.select(F.col(customer).alias("_cust"), _install_key(installed).alias("_d"))
            .where(F.col("_cust").isNotNull()).distinct())
    sides = [F.struct(F.lit(0).alias("_kind"), F.col("_d").alias("_t"), F.lit(_BEFORE).alias("_tie"))]
    sides += [F.struct(F.lit(n).alias("_kind"), window_upper_bound("_d", n).alias("_t"),
                       F.lit(_AT_OR_BEFORE).alias("_tie")) for n in positive]
    query_rows = keys.select("_cust", "_d", F.explode(F.array(*sides)).alias("_s")).select(
        "_cust", "_d", "_s.*")
    counted = incident_prefix_counts(incidents, query_rows, priorities, group_totals=with_total,
                                     include_all=False, ranges=ranges)

    def at(kind, p):
        return F.max(F.when(F.col("_kind") == kind, F.col(f"_n_p{p}")))

    cols = []
    for p in priorities:
        for n in windows:
            if n == 0:
                cols.append(F.max(f"_n_p{p}_total").alias(priority_count_column(p, 0)))
            else:
                cols.append((at(n, p) - at(0, p)).alias(priority_count_column(p, n)))
    return counted.groupBy("_cust", "_d").agg(*cols)


def add_priority_counts(orderatoms: DataFrame, incidents: DataFrame, priorities=PRIORITIES,
                        windows=WINDOW_DAYS, customer: str = "customer_finance_ref",
                        installed: str = "orderatom_dateinstalled",
                        ranges: int | None = None) -> DataFrame:
    """Add the priority x window count columns to the order atoms.

    A zero count is null, as the per-column left joins of the original
    procedure leave it.
    """
    names = [priority_count_column(p, n) for p in priorities for n in windows]
    if any(n > 0 for n in windows):
        counts = shared_table(priority_window_counts(orderatoms, incidents, priorities, windows, customer, installed,
                                                     ranges), "window-counts")
        cond = (F.col(customer) == F.col("_cust")) & (_install_key(installed) == F.col("_d"))
        out = orderatoms.join(counts, cond, "left_outer").drop("_cust", "_d")
    else:
        totals = shared_table(priority_totals_per_customer(incidents, priorities), "priority-totals")
        out = orderatoms.join(totals, F.col(customer) == F.col("_cust"), "left_outer").drop("_cust")
    return out.select(*orderatoms.columns, *[_nullif_zero(F.col(n)).alias(n) for n in names])


def incident_partners(orderatoms: DataFrame, incidents: DataFrame,
                      customer: str = "customer_finance_ref",
                      inc_customer: str = "incident_customer_finance_ref",
                      created: str = "incident_created") -> DataFrame:
    """J5, re-aimed: what the order-atom-to-incident left join yields per order
    atom (partner count, first/last incident time) without emitting the pairs.
    """
    per_customer = shared_table(incidents.groupBy(F.col(inc_customer).alias("_cust")).agg(
        F.count(F.lit(1)).alias("incident_partners"),
        F.min(created).alias("first_incident_created"),
        F.max(created).alias("last_incident_created")), "partners")
    joined = orderatoms.join(per_customer, orderatoms[customer] == per_customer["_cust"], "left_outer")
    return joined.select("orderatom_orderatomid",
                         F.coalesce("incident_partners", F.lit(0)).alias("incident_partners"),
                         "first_incident_created", "last_incident_created")


def incidents_before_cancel(orderatoms: DataFrame, incidents: DataFrame,
                            customer: str = "customer_finance_ref",
                            cancel_date: str = "orderatom_canceldate") -> DataFrame:
    """Incidents of the customer not created after the order's cancellation
    (all of them when the order has no cancel date).

    One prefix pass over distinct (customer, cancel date) query rows; the
    all-incidents total for orders without a cancel date comes from the
    per-customer totals of the same pass.
    """
    no_date = F.lit(_NO_CANCEL_DATE).cast("timestamp_ntz")
    query_rows = (orderatoms.select(F.col(customer).alias("_cust"), F.col(cancel_date).alias("_t"))
                  .where(F.col("_cust").isNotNull()).distinct()
                  .select("_cust", "_t", F.lit(_AT_OR_BEFORE).alias("_tie"),
                          F.coalesce(F.col("_t"), no_date).alias("_c")))
    counted = incident_prefix_counts(incidents, query_rows, priorities=(), group_totals=True)
    per_key = shared_table(counted.select(
        "_cust", "_c",
        F.when(F.col("_t").isNull(), F.col("_n_all_total")).otherwise(F.col("_n_all")).alias("_n")), "before-cancel")
    cond = ((F.col(customer) == F.col("_cust"))
            & (F.coalesce(F.col(cancel_date), no_date) == F.col("_c")))
    joined = orderatoms.join(per_key, cond, "left_outer")
    return joined.select("orderatom_orderatomid",
                         F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("incidents_before_cancel"))
