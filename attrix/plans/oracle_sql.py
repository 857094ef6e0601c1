"""DuckDB oracle SQL for the query catalogue.

Each oracle is an independent SQL formulation over the driver tables, built
from named CTE blocks (fixture views -> cleaned -> labeled -> aggregates).
The pairwise joins Spark avoids (order atoms x incidents) are written out
plainly here: the oracle only has to be obviously right, not scalable.
"""

from __future__ import annotations

from attrix.functions.expressions import (SERVICE_REPLACED_REASON, SURVEY_METRIC_TYPE,
                                         TEST_ORDER_REASON)
from attrix.operators.clean import CLEAN_SPECS
from attrix.operators.window_counts import PRIORITIES, WINDOW_DAYS, priority_count_column
from attrix.plans.features import DEFAULT_ANALYSIS_DATE
from attrix.sources.fixtures import VIEW_COLUMNS, fixture_cte

_CTES: dict[str, tuple[str, list[str]]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (f"{name} AS ({body})", list(needs))


def with_ctes(select: str, *needs: str, local: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``select`` with the CTEs it needs (dependencies first), then any
    query-local ``(name, body)`` CTEs."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in _CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [_CTES[n][0] for n in order] + [f"{n} AS ({b})" for n, b in (local or [])]
    if not parts:
        return select
    return "WITH " + ",\n".join(parts) + "\n" + select


for _view in VIEW_COLUMNS:
    _CTES[f"fx_{_view}"] = (fixture_cte(_view), [])


def _dedupe_body(view: str) -> str:
    spec = CLEAN_SPECS[view]
    cols = VIEW_COLUMNS[view]
    where = " AND ".join(f"{c} IS NOT NULL" for c in spec.null_columns)
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in cols if c not in spec.key_columns)
    return (f"SELECT * FROM fx_{view} WHERE {where} QUALIFY row_number() OVER "
            f"(PARTITION BY {', '.join(spec.key_columns)} ORDER BY {order}) = 1")


for _view in VIEW_COLUMNS:
    _cte(f"{_view}_c", _dedupe_body(_view), f"fx_{_view}")

_cte("assessment_f", f"SELECT * FROM assessment_c WHERE asmt_metric_type = '{SURVEY_METRIC_TYPE}'",
     "assessment_c")
_cte("orderatom_f",
     f"SELECT * FROM orderatom_c WHERE orderatom_cancelation_reason <> '{TEST_ORDER_REASON}'",
     "orderatom_c")

LABEL_SQL = (f"CASE WHEN orderatom_state = 'cancelled' AND orderatom_cancelation_reason <> "
             f"'{SERVICE_REPLACED_REASON}' AND orderatom_canceldate IS NOT NULL THEN 1 ELSE 0 END")
DAYS_SQL = (f"date_diff('day', CAST(orderatom_dateinstalled AS DATE), "
            f"DATE '{DEFAULT_ANALYSIS_DATE}')")
_cte("labeled", f"SELECT *, {LABEL_SQL} AS cancelled, {DAYS_SQL} AS days_installed FROM orderatom_f",
     "orderatom_f")
_cte("complaints", "SELECT csi_ticket_customer_finance_ref, count(csi_ticket_sys_id) AS number_complaints "
     "FROM ticket_c GROUP BY csi_ticket_customer_finance_ref", "ticket_c")
_cte("crs", "SELECT asmt_customer_finance_ref, CAST(sum(CAST(asmt_result_actual_value AS DECIMAL(18,2))) AS DOUBLE) AS crs_score "
     "FROM assessment_f GROUP BY asmt_customer_finance_ref", "assessment_f")
_cte("incidents", "SELECT incident_customer_finance_ref, count(incident_number) AS number_incidents "
     "FROM incident_c GROUP BY incident_customer_finance_ref", "incident_c")
_cte("analysis",
     "SELECT l.*, c.csi_ticket_customer_finance_ref, c.number_complaints, "
     "s.asmt_customer_finance_ref, s.crs_score, i.number_incidents FROM labeled l "
     "LEFT JOIN complaints c ON l.customer_finance_ref = c.csi_ticket_customer_finance_ref "
     "LEFT JOIN crs s ON l.customer_finance_ref = s.asmt_customer_finance_ref "
     "LEFT JOIN incidents i ON l.customer_finance_ref = i.incident_customer_finance_ref",
     "labeled", "complaints", "crs", "incidents")
_cte("features",
     "SELECT orderatom_orderatomid, coalesce(days_installed, 0) AS days_installed, "
     "coalesce(orderatom_service_install_cost, 0) AS orderatom_service_install_cost, "
     "coalesce(orderatom_total_annual_recurr_cost, 0) AS orderatom_total_annual_recurr_cost, "
     "coalesce(number_incidents, 0) AS number_incidents, "
     "coalesce(number_complaints, 0) AS number_complaints, "
     "coalesce(crs_score, 0) AS crs_score, cancelled FROM analysis", "analysis")
# Order atoms paired with every incident of their customer (the plain join).
_cte("pairs",
     "SELECT o.orderatom_orderatomid, o.orderatom_dateinstalled, o.orderatom_canceldate, "
     "i.incident_number, i.incident_created, i.incident_priority FROM labeled o "
     "JOIN incident_c i ON o.customer_finance_ref = i.incident_customer_finance_ref",
     "labeled", "incident_c")


def _window_cond(days: int) -> str:
    if days == 0:
        return ""
    return (f" AND incident_created >= orderatom_dateinstalled AND incident_created <= "
            f"CAST(orderatom_dateinstalled AS DATE) + {days}")


def priority_counts_sql(priorities=PRIORITIES, windows=WINDOW_DAYS, base: str = "labeled", extra=()) -> str:
    """The count columns of each row of ``base``, after its columns ``extra``."""
    cols = [f"nullif(count(DISTINCT CASE WHEN incident_priority = {p}{_window_cond(n)} "
            f"THEN incident_number END), 0) AS {priority_count_column(p, n)}"
            for p in priorities for n in windows]
    names = [priority_count_column(p, n) for p in priorities for n in windows]
    counts = f"SELECT orderatom_orderatomid, {', '.join(cols)} FROM pairs GROUP BY orderatom_orderatomid"
    shown = ["l.orderatom_orderatomid", *[f"l.{c}" for c in extra], *[f"pc.{n}" for n in names]]
    return with_ctes(
        f"SELECT {', '.join(shown)} "
        f"FROM {base} l LEFT JOIN pc ON l.orderatom_orderatomid = pc.orderatom_orderatomid",
        base, "pairs", local=[("pc", counts)])