"""Query catalogue: one Spark query per operator of the inventory, each with
an oracle SQL where SQL can express it.

Every query reads the driver tables of ``sf_dir`` through the fixture views
and runs over the whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.operators import aggregates as agg
from attrix.operators import window_counts as wc
from attrix.operators.bucketed import BucketedTables
from attrix.operators.clean import (CLEAN_SPECS, clean, clean_report, clean_view, drop_duplicate_rows,
                                   drop_null_rows, filter_valid_priority)
from attrix.operators.clean_store import CleanStore, clean_and_count
from attrix.operators.joins import JOIN_TYPES, join_aggregate, join_on_keys
from attrix.plans import oracle_sql as osql
from attrix.plans.features import (DEFAULT_ANALYSIS_DATE, KEY_COLUMN, analysis_frame, churn_features, feature_frame,
                                   label_orderatoms, load_clean_sources)
from attrix.session import settled, shared_folder, shared_table
from attrix.sources.fixtures import VIEW_COLUMNS, load_view

Query = Callable[[SparkSession, str], DataFrame]

# Identifiers that must not become features (customer name / keys).
EXCLUDED_COLUMNS = ["customer_name", "customer_finance_ref", "csi_ticket_customer_finance_ref",
                    "asmt_customer_finance_ref"]


def select_except(df: DataFrame, exclude) -> DataFrame:
    """All columns except ``exclude``, in their original order."""
    return df.select(*[c for c in df.columns if c not in set(exclude)])


# --------------------------------------------------------------------- scans
def _scan(view: str) -> Query:
    return lambda spark, sf: load_view(spark, sf, view)


def _clean_only(view: str) -> Query:
    spec = CLEAN_SPECS[view]
    return lambda spark, sf: clean(load_view(spark, sf, view), spec.null_columns, spec.key_columns)


def q_drop_null_rows(spark, sf):
    return drop_null_rows(load_view(spark, sf, "orderatom"), CLEAN_SPECS["orderatom"].null_columns)


def q_drop_duplicate_rows(spark, sf):
    return drop_duplicate_rows(load_view(spark, sf, "incident"), ["incident_number"])


def q_filter_survey_type(spark, sf):
    return clean_view(load_view(spark, sf, "assessment"), "assessment")


def q_filter_test_orders(spark, sf):
    return clean_view(load_view(spark, sf, "orderatom"), "orderatom")


def q_filter_valid_priority(spark, sf):
    return filter_valid_priority(clean_view(load_view(spark, sf, "incident"), "incident"))


def q_clean_report(spark, sf):
    frames = [clean_report(load_view(spark, sf, v), v) for v in VIEW_COLUMNS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _clean_in_batches(view: str) -> Query:
    """Two batches into a store of survivors; rows of one key may come with either."""
    def run(spark, sf):
        rows = load_view(spark, sf, view)
        store = CleanStore(spark, shared_folder(spark, f"store-{view}"), view)
        batch = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
        for k in (0, 1):
            store.merge(rows.filter(batch == k))
        return store.clean()
    return run


def q_clean_counts_on_write(spark, sf):
    """C3 without a scan of its own: the counts observed while the cleaned views are written."""
    reports = [clean_and_count(load_view(spark, sf, v), v, shared_folder(spark, f"clean-{v}"))[1] for v in VIEW_COLUMNS]
    return reduce(DataFrame.unionByName, reports)


# --------------------------------------------------------------------- joins
def _labeled(spark, sf):
    src = load_clean_sources(spark, sf)
    return src, label_orderatoms(src.orderatom, DEFAULT_ANALYSIS_DATE)


def q_join_diff_key(spark, sf):
    src, labeled = _labeled(spark, sf)
    joined = join_on_keys(labeled, agg.complaints_per_customer(src.ticket),
                          ["customer_finance_ref", "csi_ticket_customer_finance_ref"])
    return joined.select(KEY_COLUMN, "customer_finance_ref", "csi_ticket_customer_finance_ref",
                         "number_complaints")


def q_join_same_key(spark, sf):
    src, labeled = _labeled(spark, sf)
    right = agg.complaints_per_customer(src.ticket).withColumnRenamed(
        "csi_ticket_customer_finance_ref", "customer_finance_ref")
    return join_on_keys(labeled.select(KEY_COLUMN, "customer_finance_ref"), right,
                        ["customer_finance_ref", "customer_finance_ref"], "left_outer")


def q_join_types(spark, sf):
    src, labeled = _labeled(spark, sf)
    right = agg.complaints_per_customer(src.ticket)
    keys = ["customer_finance_ref", "csi_ticket_customer_finance_ref"]
    frames = [join_on_keys(labeled, right, keys, how)
              .agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(how).alias("join_type"), "row_count") for how in JOIN_TYPES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _feat(column: str, builder, keys, round_to: int | None = None) -> Query:
    def run(spark, sf):
        src, labeled = _labeled(spark, sf)
        joined = join_aggregate(labeled, builder(src), keys)
        value = F.col(column) if round_to is None else F.round(column, round_to)
        return joined.select(KEY_COLUMN, value.alias(column))
    return run


q_feat_complaints = _feat("number_complaints", lambda s: agg.complaints_per_customer(s.ticket),
                          ["customer_finance_ref", "csi_ticket_customer_finance_ref"])
q_feat_crs_score = _feat("crs_score", lambda s: agg.crs_score_per_customer(s.assessment),
                         ["customer_finance_ref", "asmt_customer_finance_ref"], 6)
q_feat_incidents = _feat("number_incidents", lambda s: agg.incidents_per_customer(s.incident),
                         ["customer_finance_ref", "incident_customer_finance_ref"])


def q_orderatom_incident_join(spark, sf):
    src, labeled = _labeled(spark, sf)
    return wc.incident_partners(labeled, src.incident)


def q_orderatom_incident_bucketed(spark, sf):
    """J5 and A5 from tables stored by customer: grouped and joined in their buckets, hot customers apart."""
    def per_customer(incidents, key):
        return incidents.groupBy(key).agg(
            F.count(F.lit(1)).alias("incident_partners"), F.min("incident_created").alias("first_incident_created"),
            F.max("incident_created").alias("last_incident_created"))

    def build():
        src, labeled = _labeled(spark, sf)
        stored = BucketedTables(spark, {"orderatoms": (labeled.select(KEY_COLUMN, "customer_finance_ref"), "customer_finance_ref"),
                                        "incidents": (src.incident, "incident_customer_finance_ref")})
        return stored.join_aggregate("orderatoms", "incidents", per_customer).select(
            KEY_COLUMN, F.coalesce("incident_partners", F.lit(0)).alias("incident_partners"),
            "first_incident_created", "last_incident_created")

    return settled(spark, build, "bucketed-partners")


# ---------------------------------------------------------------- aggregates
def q_row_count(spark, sf):
    return agg.row_count(churn_features(spark, sf))


def q_agg_complaints(spark, sf):
    return agg.complaints_per_customer(load_clean_sources(spark, sf).ticket)


def q_agg_crs_score(spark, sf):
    out = agg.crs_score_per_customer(load_clean_sources(spark, sf).assessment)
    return out.withColumn("crs_score", F.round("crs_score", 6))


def q_agg_incidents(spark, sf):
    return agg.incidents_per_customer(load_clean_sources(spark, sf).incident)


def q_agg_incidents_distinct(spark, sf):
    """A4 on the raw view, whose rows repeat: distinct incidents per customer and month, and (month null) per customer,
    rolled up from the months' bitmaps."""
    customer, number = "incident_customer_finance_ref", "incident_number"
    rows = load_view(spark, sf, "incident").where(f"{customer} is not null and incident_created is not null").select(
        customer, F.date_trunc("month", "incident_created").cast("date").alias("month"), number)
    months = shared_table(agg.distinct_bitmaps(rows, [customer, "month"], number), "incident-bitmaps")
    totals = agg.count_bitmaps(agg.merge_bitmaps(months, [customer]), [customer], "number_incidents")
    per_month = agg.count_bitmaps(months, [customer, "month"], "number_incidents")
    return per_month.unionByName(totals.withColumn("month", F.lit(None).cast("date")))


def _priority_counts(windows) -> Query:
    def run(spark, sf):
        src, labeled = _labeled(spark, sf)
        out = wc.add_priority_counts(labeled, src.incident, wc.PRIORITIES, windows)
        return out.select(KEY_COLUMN, *wc.priority_count_columns(wc.PRIORITIES, windows))
    return run


q_incident_priority_total = _priority_counts((0,))
q_incident_priority_window = _priority_counts((50,))
q_incident_priority_counts = _priority_counts(wc.WINDOW_DAYS)


def q_incident_before_cancel(spark, sf):
    src, labeled = _labeled(spark, sf)
    return wc.incidents_before_cancel(labeled, src.incident)


def q_churn_features(spark, sf):
    return churn_features(spark, sf)


def q_class_balance(spark, sf):
    return agg.class_balance(churn_features(spark, sf))


# --------------------------------------------------------------- projections
def q_project_features(spark, sf):
    return feature_frame(analysis_frame(load_clean_sources(spark, sf), DEFAULT_ANALYSIS_DATE), key=None)


def q_project_exclude(spark, sf):
    return select_except(analysis_frame(load_clean_sources(spark, sf), DEFAULT_ANALYSIS_DATE), EXCLUDED_COLUMNS)


# What the full analysis frame shows beside its key and the 20 count columns.
FULL_COLUMNS = ("cancelled", "days_installed", "number_complaints", "crs_score", "number_incidents")


def q_analysis_frame_full(spark, sf):
    full = analysis_frame(load_clean_sources(spark, sf), DEFAULT_ANALYSIS_DATE, priority_counts=True)
    return full.select(KEY_COLUMN, *FULL_COLUMNS, *wc.priority_count_columns())


def q_label_cancelled(spark, sf):
    _, labeled = _labeled(spark, sf)
    return labeled.select(KEY_COLUMN, "orderatom_state", "orderatom_cancelation_reason",
                          "orderatom_canceldate", "cancelled")


def q_days_installed(spark, sf):
    _, labeled = _labeled(spark, sf)
    return labeled.select(KEY_COLUMN, "orderatom_dateinstalled", "days_installed")


DATA_QUERIES: dict[str, Query] = {
    "scan_incident": _scan("incident"),
    "scan_orderatom": _scan("orderatom"),
    "scan_ticket": _scan("ticket"),
    "scan_assessment": _scan("assessment"),
    "drop_null_rows": q_drop_null_rows,
    "drop_duplicate_rows": q_drop_duplicate_rows,
    "clean_incident": _clean_only("incident"),
    "clean_ticket": _clean_only("ticket"),
    "clean_assessment": _clean_only("assessment"),
    "clean_orderatom": _clean_only("orderatom"),
    "filter_survey_type": q_filter_survey_type,
    "filter_test_orders": q_filter_test_orders,
    "filter_valid_priority": q_filter_valid_priority,
    "clean_report": q_clean_report,
    "clean_incident_in_batches": _clean_in_batches("incident"),
    "clean_orderatom_in_batches": _clean_in_batches("orderatom"),
    "clean_counts_on_write": q_clean_counts_on_write,
    "join_diff_key": q_join_diff_key,
    "join_same_key": q_join_same_key,
    "join_types": q_join_types,
    "feat_complaints": q_feat_complaints,
    "feat_crs_score": q_feat_crs_score,
    "feat_incidents": q_feat_incidents,
    "orderatom_incident_join": q_orderatom_incident_join,
    "orderatom_incident_bucketed": q_orderatom_incident_bucketed,
    "row_count": q_row_count,
    "agg_complaints": q_agg_complaints,
    "agg_crs_score": q_agg_crs_score,
    "agg_incidents": q_agg_incidents,
    "agg_incidents_distinct": q_agg_incidents_distinct,
    "incident_priority_total": q_incident_priority_total,
    "incident_priority_window": q_incident_priority_window,
    "incident_priority_counts": q_incident_priority_counts,
    "incident_before_cancel": q_incident_before_cancel,
    "churn_features": q_churn_features,
    "class_balance": q_class_balance,
    "analysis_frame_full": q_analysis_frame_full,
    "project_features": q_project_features,
    "project_exclude": q_project_exclude,
    "label_cancelled": q_label_cancelled,
    "days_installed": q_days_installed,
}


# ------------------------------------------------------------------ oracles
def _cols(view: str) -> str:
    return ", ".join(VIEW_COLUMNS[view])


def _not_null(view: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in CLEAN_SPECS[view].null_columns)


def _clean_report_sql() -> str:
    parts, needs = [], []
    for view, spec in CLEAN_SPECS.items():
        parts.append(f"SELECT '{view}' AS view_name, 'loaded' AS stage, count(*) AS row_count FROM fx_{view}")
        parts.append(f"SELECT '{view}', 'not_null', count(*) FROM fx_{view} WHERE {_not_null(view)}")
        parts.append(f"SELECT '{view}', 'deduplicated', count(*) FROM {view}_c")
        needs.append(f"{view}_c")
        if spec.post_filter is not None:
            parts.append(f"SELECT '{view}', '{spec.post_filter_name}', count(*) FROM {view}_f")
            needs.append(f"{view}_f")
    return osql.with_ctes("\nUNION ALL ".join(parts), *needs)


def _join_types_sql() -> str:
    on = "l.customer_finance_ref = c.csi_ticket_customer_finance_ref"
    sql = {
        "inner": f"SELECT count(*) FROM labeled l JOIN complaints c ON {on}",
        "left_outer": f"SELECT count(*) FROM labeled l LEFT JOIN complaints c ON {on}",
        "right_outer": f"SELECT count(*) FROM labeled l RIGHT JOIN complaints c ON {on}",
        "full_outer": f"SELECT count(*) FROM labeled l FULL JOIN complaints c ON {on}",
        "left_semi": f"SELECT count(*) FROM labeled l WHERE EXISTS (SELECT 1 FROM complaints c WHERE {on})",
        "left_anti": f"SELECT count(*) FROM labeled l WHERE NOT EXISTS (SELECT 1 FROM complaints c WHERE {on})",
    }
    body = "\nUNION ALL ".join(f"SELECT '{how}' AS join_type, ({sql[how]}) AS row_count"
                               for how in JOIN_TYPES)
    return osql.with_ctes(body, "labeled", "complaints")


def _analysis_columns() -> list[str]:
    return (VIEW_COLUMNS["orderatom"] + ["cancelled", "days_installed", "csi_ticket_customer_finance_ref",
                                         "number_complaints", "asmt_customer_finance_ref", "crs_score",
                                         "number_incidents"])


def _project_exclude_sql() -> str:
    cols = [("round(crs_score, 6) AS crs_score" if c == "crs_score" else c)
            for c in _analysis_columns() if c not in EXCLUDED_COLUMNS]
    return osql.with_ctes(f"SELECT {', '.join(cols)} FROM analysis", "analysis")


def _priority_subset_sql(windows) -> str:
    names = wc.priority_count_columns(wc.PRIORITIES, windows)
    return f"SELECT orderatom_orderatomid, {', '.join(names)} FROM ({osql.priority_counts_sql()}) t"


_PARTNERS_SQL = osql.with_ctes(
    "SELECT o.orderatom_orderatomid, count(i.incident_number) AS incident_partners, "
    "min(i.incident_created) AS first_incident_created, "
    "max(i.incident_created) AS last_incident_created FROM labeled o "
    "LEFT JOIN incident_c i ON o.customer_finance_ref = i.incident_customer_finance_ref "
    "GROUP BY o.orderatom_orderatomid", "labeled", "incident_c")


DATA_ORACLES: dict[str, str] = {
    "scan_incident": osql.with_ctes(f"SELECT {_cols('incident')} FROM fx_incident", "fx_incident"),
    "scan_orderatom": osql.with_ctes(f"SELECT {_cols('orderatom')} FROM fx_orderatom", "fx_orderatom"),
    "scan_ticket": osql.with_ctes(f"SELECT {_cols('ticket')} FROM fx_ticket", "fx_ticket"),
    "scan_assessment": osql.with_ctes(f"SELECT {_cols('assessment')} FROM fx_assessment", "fx_assessment"),
    "drop_null_rows": osql.with_ctes(f"SELECT * FROM fx_orderatom WHERE {_not_null('orderatom')}",
                                     "fx_orderatom"),
    "drop_duplicate_rows": osql.with_ctes(
        "SELECT * FROM fx_incident QUALIFY row_number() OVER (PARTITION BY incident_number ORDER BY "
        "incident_created ASC NULLS FIRST, incident_priority ASC NULLS FIRST, "
        "incident_customer_finance_ref ASC NULLS FIRST, incident_customer_name ASC NULLS FIRST) = 1",
        "fx_incident"),
    "clean_incident": osql.with_ctes("SELECT * FROM incident_c", "incident_c"),
    "clean_ticket": osql.with_ctes("SELECT * FROM ticket_c", "ticket_c"),
    "clean_assessment": osql.with_ctes("SELECT * FROM assessment_c", "assessment_c"),
    "clean_orderatom": osql.with_ctes("SELECT * FROM orderatom_c", "orderatom_c"),
    "filter_survey_type": osql.with_ctes("SELECT * FROM assessment_f", "assessment_f"),
    "filter_test_orders": osql.with_ctes("SELECT * FROM orderatom_f", "orderatom_f"),
    "filter_valid_priority": osql.with_ctes(
        "SELECT * FROM incident_c WHERE TRY_CAST(incident_priority AS INTEGER) BETWEEN 1 AND 5",
        "incident_c"),
    "clean_report": _clean_report_sql(),
    "clean_incident_in_batches": osql.with_ctes("SELECT * FROM incident_c", "incident_c"),
    "clean_orderatom_in_batches": osql.with_ctes("SELECT * FROM orderatom_f", "orderatom_f"),
    "clean_counts_on_write": _clean_report_sql(),
    "join_diff_key": osql.with_ctes(
        "SELECT l.orderatom_orderatomid, l.customer_finance_ref, c.csi_ticket_customer_finance_ref, "
        "c.number_complaints FROM labeled l JOIN complaints c "
        "ON l.customer_finance_ref = c.csi_ticket_customer_finance_ref", "labeled", "complaints"),
    "join_same_key": osql.with_ctes(
        "SELECT l.customer_finance_ref, l.orderatom_orderatomid, c.number_complaints FROM labeled l "
        "LEFT JOIN complaints c ON l.customer_finance_ref = c.csi_ticket_customer_finance_ref",
        "labeled", "complaints"),
    "join_types": _join_types_sql(),
    "feat_complaints": osql.with_ctes("SELECT orderatom_orderatomid, number_complaints FROM analysis",
                                      "analysis"),
    "feat_crs_score": osql.with_ctes(
        "SELECT orderatom_orderatomid, round(crs_score, 6) AS crs_score FROM analysis", "analysis"),
    "feat_incidents": osql.with_ctes("SELECT orderatom_orderatomid, number_incidents FROM analysis",
                                     "analysis"),
    "orderatom_incident_join": _PARTNERS_SQL,
    "orderatom_incident_bucketed": _PARTNERS_SQL,
    "row_count": osql.with_ctes("SELECT count(*) AS row_count FROM features", "features"),
    "agg_complaints": osql.with_ctes("SELECT * FROM complaints", "complaints"),
    "agg_crs_score": osql.with_ctes(
        "SELECT asmt_customer_finance_ref, round(crs_score, 6) AS crs_score FROM crs", "crs"),
    "agg_incidents": osql.with_ctes("SELECT * FROM incidents", "incidents"),
    "agg_incidents_distinct": osql.with_ctes(
        "SELECT incident_customer_finance_ref, month, count(DISTINCT incident_number) AS number_incidents FROM "
        "(SELECT *, CAST(date_trunc('month', incident_created) AS DATE) AS month FROM fx_incident "
        "WHERE incident_customer_finance_ref IS NOT NULL AND incident_created IS NOT NULL) t "
        "GROUP BY GROUPING SETS ((incident_customer_finance_ref, month), (incident_customer_finance_ref)) "
        "HAVING count(DISTINCT incident_number) > 0", "fx_incident"),
    "incident_priority_total": _priority_subset_sql((0,)),
    "incident_priority_window": _priority_subset_sql((50,)),
    "incident_priority_counts": osql.priority_counts_sql(),
    "analysis_frame_full": osql.priority_counts_sql(base="analysis", extra=FULL_COLUMNS),
    "incident_before_cancel": osql.with_ctes(
        "SELECT o.orderatom_orderatomid, count(i.incident_number) AS incidents_before_cancel "
        "FROM labeled o LEFT JOIN incident_c i "
        "ON o.customer_finance_ref = i.incident_customer_finance_ref "
        "AND (o.orderatom_canceldate IS NULL OR i.incident_created <= o.orderatom_canceldate) "
        "GROUP BY o.orderatom_orderatomid", "labeled", "incident_c"),
    "churn_features": osql.with_ctes("SELECT * FROM features", "features"),
    "class_balance": osql.with_ctes(
        "SELECT count(*) AS total_rows, CAST(count_if(cancelled = 1) AS BIGINT) AS positive_rows, "
        "CAST(count_if(cancelled = 0) AS BIGINT) AS negative_rows FROM features", "features"),
    "project_features": osql.with_ctes(
        "SELECT days_installed, orderatom_service_install_cost, orderatom_total_annual_recurr_cost, "
        "number_incidents, number_complaints, crs_score, cancelled FROM features", "features"),
    "project_exclude": _project_exclude_sql(),
    "label_cancelled": osql.with_ctes(
        "SELECT orderatom_orderatomid, orderatom_state, orderatom_cancelation_reason, "
        "orderatom_canceldate, cancelled FROM labeled", "labeled"),
    "days_installed": osql.with_ctes(
        "SELECT orderatom_orderatomid, orderatom_dateinstalled, days_installed FROM labeled", "labeled"),
}


def all_queries() -> dict[str, Query]:
    from attrix.plans.model_queries import MODEL_QUERIES
    return {**DATA_QUERIES, **MODEL_QUERIES}


def all_oracles() -> dict[str, str]:
    from attrix.plans.model_queries import MODEL_ORACLES
    return {**DATA_ORACLES, **MODEL_ORACLES}
