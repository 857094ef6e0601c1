"""attrix: order-cancellation (churn) analytics as composable Spark DataFrame operators.

Sub-packages
------------
sources    fixture views over the driver tables, JDBC loading, model persistence
operators  cleaning, joins, aggregates, skew-safe prefix counts
functions  scalar column expressions (label, tenure, guarded ratios, formatting)
plans      feature frame, ML preparation / models / tuning, evaluation, query catalogue
streaming  incremental scoring of new rows with a saved model
"""

__version__ = "0.1.0"
