"""Logistic scoring with known coefficients (T8 as column expressions).

This is exactly what ``LogisticRegressionModel.transform`` computes for a
binary model -- margin ``b + w.x``, probability ``sigmoid(margin)``,
prediction ``margin > 0`` (threshold 0.5) -- written with built-in functions,
so coefficients can be applied without a fitted model object and the same
formula can be checked by any SQL engine.  With ``digits``, margins are rounded
first, so that ties are identical across engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Coefficients of the deterministic score used to check the
# metric operators (chosen, not fitted).
# ---------------------------------------------------------------------------
CHECK_INTERCEPT = -3.0
CHECK_WEIGHTS = {"days_installed": 0.002, "orderatom_service_install_cost": 0.00002,
                 "orderatom_total_annual_recurr_cost": -0.000002, "number_incidents": 0.01,
                 "number_complaints": -0.05, "crs_score": -0.0004}


def margin(weights: dict, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, w in weights.items():
        out = out + F.col(name).cast("double") * F.lit(float(w))
    return out


def score_logistic(df: DataFrame, weights: dict = None, intercept: float = None,
                   digits: int | None = None) -> DataFrame:
    """Add ``margin``, ``probability`` (positive class) and ``prediction``."""
    weights = CHECK_WEIGHTS if weights is None else weights
    intercept = CHECK_INTERCEPT if intercept is None else intercept
    def shown(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    return (df.withColumn("margin", shown(margin(weights, intercept)))
              .withColumn("probability", shown(1.0 / (1.0 + F.exp(-F.col("margin")))))
              .withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(0.0)))


def margin_sql(weights: dict = None, intercept: float = None) -> str:
    """The same margin in SQL (explicit doubles, same evaluation order)."""
    weights = CHECK_WEIGHTS if weights is None else weights
    intercept = CHECK_INTERCEPT if intercept is None else intercept
    out = f"CAST('{float(intercept)!r}' AS DOUBLE)"
    for name, w in weights.items():
        out = f"({out} + CAST({name} AS DOUBLE) * CAST('{float(w)!r}' AS DOUBLE))"
    return out
