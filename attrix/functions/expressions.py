"""Scalar column expressions (F1-F7).  All built-in, JVM-side, codegen-friendly."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Literals the label and filters compare against.
# ---------------------------------------------------------------------------
CANCELLED_STATE = "cancelled"
SERVICE_REPLACED_REASON = "Service Replaced"
TEST_ORDER_REASON = "Products test order - please ignore"
SURVEY_METRIC_TYPE = "Customer Relationship Survey"
CONFUSION_CELL_NAMES = ["True Neg", "False Pos", "False Neg", "True Pos"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cancel_label(state="orderatom_state", reason="orderatom_cancelation_reason",
                 cancel_date="orderatom_canceldate", cancelled_value: str = CANCELLED_STATE,
                 replaced_reason: str = SERVICE_REPLACED_REASON) -> Column:
    """1 when cancelled, not replaced, and a cancel date exists; else 0.

    A null reason makes the condition unknown, so it falls to 0.
    """
    cond = ((_col(state) == F.lit(cancelled_value))
            & (_col(reason) != F.lit(replaced_reason))
            & _col(cancel_date).isNotNull())
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def analysis_date_col(analysis_date=None) -> Column:
    """the 'today' of the analysis; a fixed date keeps results reproducible."""
    if analysis_date is None:
        return F.current_date()
    if isinstance(analysis_date, (_dt.date, _dt.datetime)):
        analysis_date = analysis_date.strftime("%Y-%m-%d")
    return F.to_date(F.lit(str(analysis_date)))


def days_since(start="orderatom_dateinstalled", analysis_date=None) -> Column:
    """whole days from ``start`` to the analysis date (as bigint)."""
    return F.datediff(analysis_date_col(analysis_date), _col(start)).cast("bigint")


def window_upper_bound(start, days: int) -> Column:
    """``date_add(start, n)`` as a timestamp -- midnight of the n-th day."""
    return F.to_timestamp_ntz(F.date_add(_col(start), days).cast("string"))


def safe_ratio(numerator, denominator, default: float = 0.0) -> Column:
    """n/d, or ``default`` when d is 0 (ANSI mode raises on x/0)."""
    d = _col(denominator)
    return F.when(d != 0, _col(numerator) / d).otherwise(F.lit(default))


def percent_label(count, total) -> Column:
    """``count/total`` as a percentage with two decimals, e.g. ``12.34%``.

    Rounded half-up in integer arithmetic so every engine prints the same text.
    """
    c, t = _col(count).cast("bigint"), _col(total).cast("bigint")
    basis = F.when(t > 0, F.floor((c * 20000 + t) / (t * 2))).cast("bigint")
    return F.concat((basis / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((basis % 100).cast("string"), 2, "0"), F.lit("%"))
