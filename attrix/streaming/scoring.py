"""S7 for arriving rows: score new feature rows with a saved model as a
Structured Streaming query.

Spark ML transformers (assembler, fitted classifiers) are stateless per row,
so the same ``transform`` runs on a streaming DataFrame; each micro-batch is
scored in parallel.  The stream's checkpoint goes under the session's shared
checkpoint folder unless a location is given.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.plans.features import FEATURE_COLUMNS, KEY_COLUMN
from attrix.plans.ml import FEATURES_VECTOR
from attrix.session import ensure_checkpoint_dir
from attrix.sources.models import load_model


def score_frame(model, rows: DataFrame, feature_columns=FEATURE_COLUMNS,
                features_col: str = FEATURES_VECTOR, keep=(KEY_COLUMN,)) -> DataFrame:
    """Assemble and score rows (batch or streaming) with a fitted model."""
    assembled = VectorAssembler(inputCols=list(feature_columns), outputCol=features_col,
                                handleInvalid="keep").transform(rows.fillna(0, subset=list(feature_columns)))
    return model.transform(assembled).select(
        *keep, "prediction", vector_to_array("probability")[1].alias("probability"))


def start_scoring(spark: SparkSession, model_path: str, source_path: str, schema, sink_path: str,
                  name: str = "scoring", checkpoint_location: str | None = None,
                  available_now: bool = True, model_class=CrossValidatorModel):
    """Stream parquet feature rows from ``source_path`` to scored parquet rows
    with the model saved at ``model_path`` (reloaded as ``model_class``)."""
    if checkpoint_location is None:
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    stream = spark.readStream.schema(schema).parquet(source_path)
    scored = score_frame(load_model(model_path, model_class), stream).withColumn("scored_at", F.current_timestamp())
    writer = (scored.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint_location).queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
