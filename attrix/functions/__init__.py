from attrix.functions.expressions import (CANCELLED_STATE, CONFUSION_CELL_NAMES, SERVICE_REPLACED_REASON,
                                         SURVEY_METRIC_TYPE, TEST_ORDER_REASON, analysis_date_col,
                                         cancel_label, days_since, percent_label, safe_ratio,
                                         window_upper_bound)

__all__ = [
    "CANCELLED_STATE", "CONFUSION_CELL_NAMES", "SERVICE_REPLACED_REASON", "SURVEY_METRIC_TYPE",
    "TEST_ORDER_REASON", "analysis_date_col", "cancel_label", "days_since", "percent_label",
    "safe_ratio", "window_upper_bound",
]
