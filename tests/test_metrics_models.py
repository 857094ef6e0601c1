"""Layers 3-4: metric operators against Spark's own evaluators, the fixed
logistic scorer against a fitted model, and model invariants."""

import os
import tempfile

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attrix.plans import evaluate as ev
from attrix.plans import ml
from attrix.plans import model_queries as mq
from attrix.plans.features import FEATURE_COLUMNS, KEY_COLUMN, LABEL_COLUMN, churn_features
from attrix.plans.scoring import score_logistic
from attrix.streaming import score_frame
from conftest import SF_SMALL

SF = SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    frame = ml.assemble_features(churn_features(spark, SF), FEATURE_COLUMNS, ml.FEATURES_VECTOR)
    train, test = ml.split_train_test(frame, KEY_COLUMN)
    train = ml.stable_training_frame(ml.with_folds(train, KEY_COLUMN), KEY_COLUMN)
    model = ml.logistic_regression(ml.FEATURES_VECTOR, LABEL_COLUMN, maxIter=20).fit(train)
    yield model, train, test
    train.unpersist()


def test_fixed_scorer_equals_model_transform(fitted):
    model, _, test = fitted
    weights = dict(zip(FEATURE_COLUMNS, model.coefficients.toArray().tolist()))
    mine = score_logistic(test, weights, model.intercept, digits=12).select(
        KEY_COLUMN, "probability", "prediction")
    theirs = model.transform(test).select(
        KEY_COLUMN, vector_to_array("probability")[1].alias("p"), F.col("prediction").alias("q"))
    joined = mine.join(theirs, KEY_COLUMN).collect()
    assert joined
    for r in joined:
        assert abs(r.probability - r.p) < 1e-9
        assert r.prediction == r.q


def test_metrics_equal_spark_evaluators(fitted):
    model, _, test = fitted
    pred = model.transform(test).withColumn("score", ev.positive_score())
    multi = MulticlassClassificationEvaluator(labelCol=LABEL_COLUMN, predictionCol="prediction")
    w = ev.weighted_metrics(pred).first()
    for col, metric in [("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"),
                        ("weighted_recall", "weightedRecall"), ("weighted_f1", "f1")]:
        assert abs(w[col] - multi.evaluate(pred, {multi.metricName: metric})) < 1e-6
    exact = BinaryClassificationEvaluator(labelCol=LABEL_COLUMN, rawPredictionCol="rawPrediction",
                                          numBins=0).evaluate(pred)
    assert abs(ev.auc_exact(pred, LABEL_COLUMN, "score").first().auc - exact) < 1e-6
    assert abs(ev.auc_exact(pred, LABEL_COLUMN, "score", ranges=7).first().auc - exact) < 1e-6
    conf = ev.confusion_metrics(pred).first()
    grouped = {(r[LABEL_COLUMN], r.prediction): r["count"]
               for r in pred.groupBy(LABEL_COLUMN, "prediction").count().collect()}
    assert conf.tp == grouped.get((1, 1.0), 0) and conf.tn == grouped.get((0, 0.0), 0)
    assert conf.fp == grouped.get((0, 1.0), 0) and conf.fn == grouped.get((1, 0.0), 0)


def test_roc_points_end_at_one_and_rise(fitted):
    model, _, test = fitted
    pred = model.transform(test).withColumn("score", ev.positive_score())
    pts = sorted((r.threshold, r.fpr, r.tpr) for r in ev.roc_points(pred, LABEL_COLUMN, "score").collect())
    assert pts[0][1:] == (1.0, 1.0)             # lowest threshold accepts everything
    fprs = [p[1] for p in reversed(pts)]
    assert fprs == sorted(fprs)


def test_unregularised_fit_mean_residual_near_zero(fitted):
    model, train, _ = fitted
    res = model.transform(train).select(
        (F.col(LABEL_COLUMN) - vector_to_array("probability")[1]).alias("r")).agg(F.avg("r")).first()[0]
    assert abs(res) < 1e-3


# Small grids for the tests; the registered queries search the full ones.
SMALL = {"logreg": {"regParam": [0.01, 0.1], "maxIter": [5]}, "dtree": {"maxDepth": [2, 5]},
         "rforest": {"maxDepth": [3], "numTrees": [5]}, "gbt": {"maxDepth": [2], "maxIter": [3]}}


def test_cv_leaderboard_has_one_row_per_setting(spark):
    rows = mq.cv_leaderboard(spark, SF, SMALL).collect()
    assert [r.model for r in rows] == ["logreg", "logreg", "dtree", "dtree", "rforest", "gbt"]
    assert all(0.0 <= r.avg_auc <= 1.0 for r in rows)


def test_full_grids_have_reference_sizes():
    sizes = {m: len(ml.param_grid(ml.MODELS[m][0]("f", "l"), ml.MODELS[m][1])) for m in ml.MODELS}
    assert sizes == {"logreg": 125, "dtree": 6, "rforest": 27, "gbt": 27}


def _test_rows(duck):
    sql = mq.osql.with_ctes("SELECT count(*), count_if(cancelled = 1) FROM test_rows", "features",
                            local=[("test_rows", mq._TEST_ROWS)])
    return duck.sql(sql).fetchall()[0]


@pytest.mark.parametrize("name", mq.MODEL_NAMES)
def test_tuned_models_report_valid_metrics(spark, duck_small, name):
    row = mq.tuned_report(spark, SF, name, SMALL[name]).first()
    assert 0.0 <= row.test_auc <= 1.0 and 0.0 <= row.cv_auc <= 1.0
    assert (row.tn + row.fp + row.fn + row.tp, row.fn + row.tp) == _test_rows(duck_small)
    assert row.settings == len(ml.param_grid(ml.MODELS[name][0]("f", "l"), SMALL[name]))


def test_saved_models_score_the_same(spark, duck_small):
    rows = mq.model_save_load_score(spark, SF, SMALL).collect()
    n, positives = _test_rows(duck_small)
    assert all(r.same for r in rows) and len(rows) == n * len(mq.MODEL_NAMES)
    assert sum(r[LABEL_COLUMN] for r in rows) == positives * len(mq.MODEL_NAMES)


def test_tuning_check_agrees_with_sql(spark, duck_small):
    """The registered check, with small grids: rows and positives of SQL, AUC of the rank sums."""
    n, positives = _test_rows(duck_small)
    rows = {r.model: r for r in mq.q_tuning_check(spark, SF, SMALL).collect()}
    assert rows.keys() == set(mq.MODEL_NAMES)
    for name, r in rows.items():
        assert (r.settings, r.test_rows, r.positives, r.auc_agrees) == (
            len(ml.param_grid(ml.MODELS[name][0]("f", "l"), SMALL[name])), n, positives, True)


def test_tuned_training_roc_runs_from_none_to_all(spark):
    points = [(r.fpr, r.tpr) for r in mq.tuned_training_roc(spark, SF, SMALL["logreg"]).collect()]
    assert min(points) == (0.0, 0.0) and max(points) == (1.0, 1.0)


def test_a_model_is_not_replaced(spark, fitted):
    from datetime import datetime
    from attrix.sources.models import save_model
    root = tempfile.mkdtemp(prefix="attrix-models-")
    save_model(fitted[0], root, "lr", datetime(2025, 1, 1))
    with pytest.raises(Exception):
        save_model(fitted[0], root, "lr", datetime(2025, 1, 1))


def test_scores_must_be_numbers(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 0.5), (0, bad)], "cancelled int, score double")
        with pytest.raises(Exception, match="null or NaN"):
            ev.auc_exact(df).collect()


def test_training_partitions_follow_the_rows(spark):
    """Arrival does not matter, and more rows make more partitions."""
    df = spark.range(1000).withColumnRenamed("id", "k")
    deals = []
    for arrived in (df.repartition(1), df.repartition(9), df.coalesce(2)):
        dealt = ml.size_partitions(arrived, "k", rows_per_partition=100)
        assert dealt.rdd.getNumPartitions() == 10
        deals.append(dealt.rdd.glom().map(lambda rows: [r.k for r in rows]).collect())
    assert deals[0] == deals[1] == deals[2]


def test_seeded_trees_do_not_depend_on_arrival(spark):
    frame = ml.assemble_features(churn_features(spark, SF), FEATURE_COLUMNS, ml.FEATURES_VECTOR)
    train, test = ml.split_train_test(frame, KEY_COLUMN)
    for build in (ml.random_forest, ml.gradient_boosted_trees):
        scores = []
        for n in (1, 9):
            dealt = ml.size_partitions(train.repartition(n), KEY_COLUMN, rows_per_partition=200)
            model = build(ml.FEATURES_VECTOR, LABEL_COLUMN, maxDepth=3).fit(dealt)
            scores.append(model.transform(test).select(KEY_COLUMN, "probability").orderBy(KEY_COLUMN).collect())
        assert scores[0] == scores[1]


def test_save_load_gives_identical_scores(spark, fitted):
    from pyspark.ml.classification import LogisticRegressionModel
    from attrix.sources.models import load_model, save_model
    model, _, test = fitted
    root = tempfile.mkdtemp(prefix="attrix-models-")
    path = save_model(model, root, "lr")
    assert path.startswith(root) and os.path.isdir(path)
    again = load_model(path, LogisticRegressionModel)
    a = model.transform(test).select(KEY_COLUMN, "probability").orderBy(KEY_COLUMN).collect()
    b = again.transform(test).select(KEY_COLUMN, "probability").orderBy(KEY_COLUMN).collect()
    assert a == b


def test_streaming_scoring_equals_batch(spark, fitted):
    model, _, _ = fitted
    rows = churn_features(spark, SF)
    batch = {r[KEY_COLUMN]: (r.prediction, round(r.probability, 12))
             for r in score_frame(model, rows).collect()}
    src = tempfile.mkdtemp(prefix="attrix-stream-src-")
    rows.write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema(rows.schema).parquet(src + "/in")
    q = (score_frame(model, stream).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", src + "/ckpt").start())
    q.processAllAvailable()
    q.stop()
    streamed = {r[KEY_COLUMN]: (r.prediction, round(r.probability, 12))
                for r in spark.sql("SELECT * FROM scored_stream").collect()}
    assert streamed == batch


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == [KEY_COLUMN] + FEATURE_COLUMNS + [LABEL_COLUMN]
    assert df.count() > 0


def test_seeded_forest_repeats_across_shuffle_orders(spark):
    """Same data arriving in different partition orders -> identical forest."""
    from pyspark.sql import functions as F
    frame = ml.assemble_features(churn_features(spark, SF), FEATURE_COLUMNS, ml.FEATURES_VECTOR)
    preds = []
    for shuffled in (frame.repartition(7, F.rand(1)), frame.repartition(7, F.rand(2))):
        train, test = ml.model_frames(shuffled.repartition(7, KEY_COLUMN), KEY_COLUMN)
        model = ml.random_forest(ml.FEATURES_VECTOR, LABEL_COLUMN, numTrees=5, maxDepth=4).fit(train)
        preds.append(sorted((r[KEY_COLUMN], r.prediction) for r in model.transform(test).collect()))
        train.unpersist()
    assert preds[0] == preds[1]


def test_start_scoring_streams_files_to_parquet(spark, fitted):
    from attrix.sources.models import save_model
    from attrix.streaming import start_scoring
    model, _, _ = fitted
    work = tempfile.mkdtemp(prefix="attrix-scoring-")
    path = save_model(model, work + "/models", "lr")
    rows = churn_features(spark, SF)
    rows.write.parquet(work + "/in")
    from pyspark.ml.classification import LogisticRegressionModel
    q = start_scoring(spark, path, work + "/in", rows.schema, work + "/out", name="score_test",
                      checkpoint_location=work + "/ckpt", model_class=LogisticRegressionModel)
    q.awaitTermination(300)
    out = spark.read.parquet(work + "/out")
    assert out.count() == rows.count()
    assert set(out.columns) >= {KEY_COLUMN, "prediction", "probability", "scored_at"}
