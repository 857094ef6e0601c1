"""Feature preparation, models and tuning (M1-M4, T1-T9), all Spark ML.

Training data is written once to the shared checkpoint folder and persisted
before iterative fitting: every optimiser iteration and every cross-validation
fold re-reads it, and a lost executor then recomputes from those files instead
of the whole join lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.session import shared_table

# ---------------------------------------------------------------------------
# Split ratios/seeds and the tuning grids of the four models.
# ---------------------------------------------------------------------------
UNIVARIATE_TRAIN_RATIO, UNIVARIATE_SEED = 0.7, 2025
MODEL_TRAIN_RATIO, MODEL_SEED = 0.8, 2809
NUM_FOLDS = 5
LOGREG_GRID = {"regParam": [0.01, 0.1, 0.5, 1.0, 2.0],
               "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0],
               "maxIter": [1, 5, 10, 20, 50]}
DTREE_GRID = {"maxDepth": [2, 5, 10], "maxBins": [10, 20]}
RFOREST_GRID = {"maxDepth": [2, 5, 10], "maxBins": [5, 10, 20], "numTrees": [5, 20, 50]}
GBT_GRID = {"maxDepth": [2, 5, 10], "maxBins": [10, 20, 40], "maxIter": [5, 10, 20]}

FEATURES_VECTOR = "feature_columns_vector"
FOLD_COLUMN = "fold"
ROWS_PER_PARTITION = 250_000   # training rows per partition (~tens of MB of vectors)


def assemble_features(df: DataFrame, input_cols, output_col: str = "features_vector",
                      drop_inputs: bool = False, handle_invalid: str = "error") -> DataFrame:
    """M1: one vector column from numeric columns (errors on nulls by default)."""
    out = VectorAssembler(inputCols=list(input_cols), outputCol=output_col,
                          handleInvalid=handle_invalid).transform(df)
    return out.drop(*input_cols) if drop_inputs else out


def scale_features(df: DataFrame, vector_col: str) -> DataFrame:
    """M2: add ``<vector_col>_scaled`` = vector / sample std (no centring).

    The std is a distributed summary (one pass); a zero-variance slot scales to 0.
    """
    scaler = StandardScaler(inputCol=vector_col, outputCol=f"{vector_col}_scaled",
                            withStd=True, withMean=False)
    return scaler.fit(df.select(vector_col)).transform(df)


def hash_bucket(key: str, seed: int, buckets: int = 1000) -> Column:
    """Deterministic pseudo-random bucket of a row key (md5 of ``seed:key``).

    Unlike ``randomSplit`` it does not depend on partitioning or row order,
    needs no shuffle, and any SQL engine with md5 computes the same value.
    """
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def split_train_test(df: DataFrame, key: str, train_ratio: float = MODEL_TRAIN_RATIO,
                     seed: int = MODEL_SEED) -> tuple[DataFrame, DataFrame]:
    """M3: hash split into (train, test) with ``train_ratio`` of the rows in train."""
    cut = int(round(train_ratio * 1000))
    bucket = hash_bucket(key, seed)
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def with_folds(df: DataFrame, key: str, folds: int = NUM_FOLDS, seed: int = MODEL_SEED + 1) -> DataFrame:
    """Deterministic fold id in [0, folds) for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(FOLD_COLUMN, hash_bucket(key, seed, folds).cast("int"))


def size_partitions(df: DataFrame, key: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Deal the rows by ``key`` into ``ceil(rows / rows_per_partition)`` partitions, sorted by ``key`` in each.

    Seeded samplers (forest bootstraps, boosting subsamples) draw per partition and row
    position.  Number, contents and order of the partitions follow from the rows alone -- not from
    cores, arrival or shuffle order -- so a seed gives the same model everywhere.
    """
    wanted = max(1, -(-df.count() // rows_per_partition))
    return df.repartition(wanted, key).sortWithinPartitions(key)


def stable_training_frame(df: DataFrame, key: str) -> DataFrame:
    """Cut lineage (one shared table), deal the rows by ``key`` (:func:`size_partitions`)
    and keep them close for iterative fits."""
    return size_partitions(shared_table(df, "training"), key).persist(StorageLevel.MEMORY_AND_DISK)


def model_frames(frame: DataFrame, key: str, train_ratio: float = MODEL_TRAIN_RATIO,
                 seed: int = MODEL_SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) from one shared table of ``frame`` with fold ids: the
    feature lineage runs once for fitting and evaluation alike; the training
    rows are dealt by :func:`size_partitions` and persisted for the iterative fits."""
    stable = shared_table(with_folds(frame, key), "model-frame")
    train, test = split_train_test(stable, key, train_ratio, seed)
    return size_partitions(train, key).persist(StorageLevel.MEMORY_AND_DISK), test


# -------------------------------------------------------------------- models
def logistic_regression(features_col: str, label_col: str, **params) -> LogisticRegression:
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, **params)


def decision_tree(features_col: str, label_col: str, seed: int = MODEL_SEED, **params):
    return DecisionTreeClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **params)


def random_forest(features_col: str, label_col: str, seed: int = MODEL_SEED, **params):
    return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **params)


def gradient_boosted_trees(features_col: str, label_col: str, seed: int = MODEL_SEED, **params):
    """Checkpoints every second round: each round's lineage holds the trees since the last checkpoint, and every job
    ships it (10 rounds of depth 10, 8 fits at once: 12 s instead of 27 s, the same models)."""
    return GBTClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **{"checkpointInterval": 2, **params})


MODELS = {
    "logreg": (logistic_regression, LOGREG_GRID),
    "dtree": (decision_tree, DTREE_GRID),
    "rforest": (random_forest, RFOREST_GRID),
    "gbt": (gradient_boosted_trees, GBT_GRID),
}


def param_grid(estimator, grid: dict) -> list:
    """The full cartesian grid of ``{param name: values}``."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def auc_evaluator(label_col: str) -> BinaryClassificationEvaluator:
    """E1 as used for tuning: area under ROC on ``rawPrediction``."""
    return BinaryClassificationEvaluator(labelCol=label_col, rawPredictionCol="rawPrediction",
                                         metricName="areaUnderROC")


def describe_params(param_map: dict) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(param_map.items(), key=lambda kv: kv[0].name))


def coefficient_rows(lr_model, feature_names) -> list[tuple]:
    """Coefficients by feature, plus the intercept."""
    coefs = lr_model.coefficients.toArray().tolist()
    return [(name, float(c)) for name, c in zip(feature_names, coefs)] + \
        [("intercept", float(lr_model.intercept))]
