"""Source views (S2-S5) and the fixture views that stand in for them.

The four business views (incident, order atom, complaint ticket, survey result)
are not part of the driver tables, so each is defined as a SQL view over
``orders``/``customer``/``lineitem``/``events``.  The *same* SQL text is used by
Spark (``spark.sql`` with DataFrame parameters, so no global temp views) and by
the DuckDB oracle (table names substituted), which keeps both sides identical.

With real data, skip the fixtures: read the views (``sources.jdbc`` or parquet)
and ``select`` the projections below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The column projections of the four source views (must match
# the reference's queries, in this order).
# ---------------------------------------------------------------------------
INCIDENT_COLUMNS = [
    "incident_number", "incident_created", "incident_priority",
    "incident_customer_finance_ref", "incident_customer_name",
]
ORDERATOM_COLUMNS = [
    "order_orderid", "order_orderdate", "order_status", "customer_custid", "customer_name",
    "customer_finance_ref", "orderatom_orderatomid", "orderatom_state", "orderatom_dateinstalled",
    "orderatom_canceldate", "orderatom_cancelation_reason", "orderatom_service_replace_type",
    "orderatom_service_install_cost", "orderatom_total_annual_recurr_cost",
    "orderatom_total_annual_recurr_value",
]
TICKET_COLUMNS = [
    "csi_ticket_sys_id", "csi_ticket_sys_created_on", "csi_ticket_subcategory",
    "csi_ticket_root_cause", "csi_ticket_subcause", "csi_ticket_root_cause_codes",
    "csi_ticket_impact", "csi_ticket_customer_finance_ref",
]
ASSESSMENT_COLUMNS = [
    "asmt_result_sys_id", "asmt_result_instance", "asmt_result_sys_created_on",
    "asmt_result_sys_updated_on", "asmt_metric_type", "asmt_result_actual_value",
    "asmt_customer_finance_ref",
]

VIEW_COLUMNS = {
    "incident": INCIDENT_COLUMNS,
    "orderatom": ORDERATOM_COLUMNS,
    "ticket": TICKET_COLUMNS,
    "assessment": ASSESSMENT_COLUMNS,
}

# Fixture view definitions over the driver tables ({name} = a driver table).
FIXTURE_SQL = {
    "orderatom": """
SELECT
  o_orderkey AS order_orderid,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS order_orderdate,
  o_orderstatus AS order_status,
  o_custkey AS customer_custid,
  c_name AS customer_name,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS customer_finance_ref,
  o_orderkey AS orderatom_orderatomid,
  CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'O' THEN 'active' ELSE 'pending' END AS orderatom_state,
  o_orderdate AS orderatom_dateinstalled,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS orderatom_canceldate,
  CASE WHEN o_orderkey % 20 = 1 THEN 'Products test order - please ignore' WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 3 THEN 'Service Replaced' WHEN o_orderstatus = 'F' THEN 'Customer request' WHEN o_orderkey % 5 = 0 THEN NULL ELSE '' END AS orderatom_cancelation_reason,
  o_orderpriority AS orderatom_service_replace_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_acctbal END AS orderatom_service_install_cost,
  o_totalprice AS orderatom_total_annual_recurr_cost,
  o_totalprice AS orderatom_total_annual_recurr_value
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "incident": """
SELECT
  l_orderkey * 10 + l_linenumber AS incident_number,
  l_shipdate AS incident_created,
  CASE l_linenumber WHEN 6 THEN NULL WHEN 7 THEN 9 ELSE l_linenumber END AS incident_priority,
  CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_partkey END AS incident_customer_finance_ref,
  l_returnflag AS incident_customer_name
FROM {lineitem}""",
    "ticket": """
SELECT
  event_id AS csi_ticket_sys_id,
  ts AS csi_ticket_sys_created_on,
  event_type AS csi_ticket_subcategory,
  event_type AS csi_ticket_root_cause,
  event_type AS csi_ticket_subcause,
  props AS csi_ticket_root_cause_codes,
  event_type AS csi_ticket_impact,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE user_id END AS csi_ticket_customer_finance_ref
FROM {events}
WHERE event_type = 'error'""",
    "assessment": """
SELECT
  event_id AS asmt_result_sys_id,
  event_id % 100 AS asmt_result_instance,
  ts AS asmt_result_sys_created_on,
  ts AS asmt_result_sys_updated_on,
  CASE event_type WHEN 'view' THEN 'Customer Relationship Survey' ELSE 'Other' END AS asmt_metric_type,
  value AS asmt_result_actual_value,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS asmt_customer_finance_ref
FROM {events}""",
}

_TABLES = {
    "orderatom": ("orders", "customer"),
    "incident": ("lineitem",),
    "ticket": ("events",),
    "assessment": ("events",),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns/pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A fixture view as a lazy DataFrame, projected to the source columns."""
    tables = {t: read_table(spark, sf_dir, t) for t in _TABLES[view]}
    return spark.sql(FIXTURE_SQL[view], **tables).select(*VIEW_COLUMNS[view])


def fixture_cte(view: str) -> str:
    """``fx_<view> AS (...)`` for an oracle query (driver tables are views there)."""
    body = FIXTURE_SQL[view].format(**{t: t for t in _TABLES[view]})
    return f"fx_{view} AS ({body}\n)"
