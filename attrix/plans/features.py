"""The churn feature frame (A9): cleaned sources -> label and tenure ->
per-customer aggregates joined onto order atoms -> selected, zero-filled features.

The three per-customer aggregates are one written table, joined once: the
order-atom side is shuffled once (or not at all, when Spark's size check finds
the table small enough to broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.functions.expressions import cancel_label, days_since
from attrix.operators.clean import clean_view
from attrix.operators.window_counts import WINDOW_DAYS, PRIORITIES, add_priority_counts
from attrix.session import shared_table
from attrix.sources.fixtures import VIEW_COLUMNS, load_view

# ---------------------------------------------------------------------------
# Model features (in order), label and row key.
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "days_installed", "orderatom_service_install_cost", "orderatom_total_annual_recurr_cost",
    "number_incidents", "number_complaints", "crs_score",
]
LABEL_COLUMN = "cancelled"
KEY_COLUMN = "orderatom_orderatomid"
DEFAULT_ANALYSIS_DATE = "2002-01-01"   # 'today' of the fixture tables, for reproducible tenure


class CleanSources:
    """The four cleaned source frames, each built on first use.

    ``loaders`` maps a view name to a function returning the raw view.
    """

    def __init__(self, loaders: dict):
        self._loaders = loaders
        self._frames: dict[str, DataFrame] = {}

    def _get(self, view: str) -> DataFrame:
        if view not in self._frames:
            self._frames[view] = clean_view(self._loaders[view](), view)
        return self._frames[view]

    @classmethod
    def written(cls, src: CleanSources) -> CleanSources:
        """The same sources with the cleaned incidents and order atoms as tables that are written once."""
        out = cls(src._loaders)
        out._frames = {**src._frames, "incident": shared_table(src.incident, "clean-incident"),
                       "orderatom": shared_table(src.orderatom, "clean-orderatom")}
        return out

    incident = property(lambda self: self._get("incident"))
    orderatom = property(lambda self: self._get("orderatom"))
    ticket = property(lambda self: self._get("ticket"))
    assessment = property(lambda self: self._get("assessment"))


def clean_sources(views: dict[str, DataFrame]) -> CleanSources:
    """Clean already-loaded views (real data: the four source DataFrames)."""
    return CleanSources({name: (lambda df=df: df) for name, df in views.items()})


def load_clean_sources(spark: SparkSession, sf_dir: str) -> CleanSources:
    return CleanSources({view: (lambda view=view: load_view(spark, sf_dir, view))
                         for view in VIEW_COLUMNS})


def label_orderatoms(orderatom: DataFrame, analysis_date=None) -> DataFrame:
    """Add ``cancelled`` and ``days_installed`` (up to today, or to ``analysis_date``)."""
    return (orderatom.withColumn(LABEL_COLUMN, cancel_label())
                     .withColumn("days_installed", days_since("orderatom_dateinstalled", analysis_date)))


def customer_table(src: CleanSources) -> DataFrame:
    """One row per customer with its complaints, survey score and incidents.

    The three sources meet in one union and one grouped aggregate with a
    map-side step.  The table is written, so that the join that follows reads
    two plain exchanges and adaptive execution can split a hot customer.
    """
    none = F.lit(None)

    def rows(df, key, complaint=none, score=none, incident=none, ticket_key=none, survey_key=none):
        return df.select(F.col(key).alias("_customer"), complaint.cast("bigint").alias("_complaint"),
                         score.cast("decimal(18,2)").alias("_score"), incident.cast("bigint").alias("_incident"),
                         ticket_key.alias("_ticket_key"), survey_key.alias("_survey_key"))

    ticket_key, survey_key = "csi_ticket_customer_finance_ref", "asmt_customer_finance_ref"
    union = (rows(src.ticket, ticket_key, complaint=F.col("csi_ticket_sys_id").isNotNull(), ticket_key=F.col(ticket_key))
             .unionByName(rows(src.assessment, survey_key, score=F.col("asmt_result_actual_value"),
                               survey_key=F.col(survey_key)))
             .unionByName(rows(src.incident, "incident_customer_finance_ref",
                               incident=F.col("incident_number").isNotNull())))
    table = union.groupBy("_customer").agg(
        F.max("_ticket_key").alias(ticket_key), F.sum("_complaint").alias("number_complaints"),
        F.max("_survey_key").alias(survey_key), F.sum("_score").cast("double").alias("crs_score"),
        F.sum("_incident").alias("number_incidents"))
    return shared_table(table, "customers")


def analysis_frame(src: CleanSources, analysis_date=None,
                   priority_counts: bool = False, priorities=PRIORITIES,
                   windows=WINDOW_DAYS) -> DataFrame:
    """Order atoms with label, tenure, complaints, survey score and incident
    count (J4), optionally with the priority x window count columns (A7)."""
    if priority_counts:  # both views are read twice: clean them once
        src = CleanSources.written(src)
    out = label_orderatoms(src.orderatom, analysis_date)
    customers = customer_table(src)
    out = out.join(customers, out["customer_finance_ref"] == customers["_customer"], "left_outer").drop("_customer")
    if priority_counts:
        out = add_priority_counts(out, src.incident, priorities, windows)
    return out


def feature_frame(analysis: DataFrame, features=FEATURE_COLUMNS, label: str = LABEL_COLUMN,
                  key: str | None = KEY_COLUMN) -> DataFrame:
    """Key (optional), features and label; numeric nulls filled with 0."""
    cols = ([key] if key else []) + list(features) + [label]
    return analysis.select(*cols).fillna(0)


def churn_features(spark: SparkSession, sf_dir: str, analysis_date=DEFAULT_ANALYSIS_DATE) -> DataFrame:
    """A9, the flagship: one row per cleaned order atom with the six features
    and the label."""
    return feature_frame(analysis_frame(load_clean_sources(spark, sf_dir), analysis_date))
