from attrix.operators.aggregates import (class_balance, complaints_per_customer, count_per_key,
                                        crs_score_per_customer, incidents_per_customer, row_count,
                                        sum_per_key)
from attrix.operators.clean import (CLEAN_SPECS, clean, clean_report, clean_view, drop_duplicate_rows,
                                   drop_null_rows, filter_not_equals,
                                   filter_valid_priority, valid_priority)
from attrix.operators.joins import JOIN_TYPES, join_on_keys
from attrix.operators.prefix import ranged_running_totals, running_totals
from attrix.operators.window_counts import (PRIORITIES, WINDOW_DAYS, add_priority_counts,
                                           incident_partners,
                                           incidents_before_cancel, priority_count_column,
                                           priority_count_columns, priority_totals_per_customer,
                                           priority_window_counts)

__all__ = [
    "class_balance", "complaints_per_customer", "count_per_key", "crs_score_per_customer",
    "incidents_per_customer", "row_count", "sum_per_key", "CLEAN_SPECS", "clean", "clean_report",
    "clean_view", "drop_duplicate_rows", "drop_null_rows", "filter_not_equals",
    "filter_valid_priority", "valid_priority", "JOIN_TYPES", "join_on_keys", "ranged_running_totals", "running_totals",
    "PRIORITIES", "WINDOW_DAYS", "add_priority_counts", "incident_partners",
    "incidents_before_cancel", "priority_count_column", "priority_count_columns",
    "priority_totals_per_customer", "priority_window_counts",
]
