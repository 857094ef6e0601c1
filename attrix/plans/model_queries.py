"""Catalogue part 2: feature vectors, split, metrics and models.

Metric operators are checked against SQL on a deterministic score (fixed
logistic coefficients over the held-out split); model fitting and tuning
queries have no SQL equivalent and are rows-only checks, with invariants in
the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.plans import evaluate as ev
from attrix.plans import ml, tuning
from attrix.plans import oracle_sql as osql
from attrix.plans.features import FEATURE_COLUMNS, KEY_COLUMN, LABEL_COLUMN, churn_features
from attrix.plans.scoring import margin_sql, score_logistic
from attrix.session import ensure_checkpoint_dir, settled, shared_table
from attrix.sources.models import load_latest, save_model

MODEL_NAMES = ("logreg", "dtree", "rforest", "gbt")


def test_split(spark, sf) -> DataFrame:
    _, test = ml.split_train_test(churn_features(spark, sf), KEY_COLUMN)
    return test


def scored_test(spark, sf) -> DataFrame:
    return score_logistic(test_split(spark, sf), digits=6)


# ------------------------------------------------------- SQL-checked queries
def q_assemble_features(spark, sf):
    vec = ml.assemble_features(churn_features(spark, sf), FEATURE_COLUMNS, "features_vector")
    arr = vector_to_array("features_vector")
    return vec.select(KEY_COLUMN, *[arr[i].alias(f"vec_{c}") for i, c in enumerate(FEATURE_COLUMNS)])


def q_scale_features(spark, sf):
    # read twice (scaler fit, then transform): materialise the features once
    vec = shared_table(ml.assemble_features(churn_features(spark, sf), FEATURE_COLUMNS, "features_vector"),
                       "assembled")
    scaled = ml.scale_features(vec, "features_vector")
    arr = vector_to_array("features_vector_scaled")
    return scaled.select(KEY_COLUMN, *[F.round(arr[i], 6).alias(f"scaled_{c}")
                                       for i, c in enumerate(FEATURE_COLUMNS)])


def q_split_train_test(spark, sf):
    frame = churn_features(spark, sf)
    bucket = ml.hash_bucket(KEY_COLUMN, ml.MODEL_SEED)
    cut = int(round(ml.MODEL_TRAIN_RATIO * 1000))
    return frame.select(KEY_COLUMN, LABEL_COLUMN,
                        F.when(bucket < cut, "train").otherwise("test").alias("split"))


def q_logreg_score(spark, sf):
    return scored_test(spark, sf).select(KEY_COLUMN, LABEL_COLUMN, "margin", "probability",
                                         "prediction")


def q_confusion_metrics(spark, sf):
    return ev.confusion_metrics(scored_test(spark, sf))


def q_confusion_cells(spark, sf):
    return ev.confusion_cells(scored_test(spark, sf))


def q_weighted_metrics(spark, sf):
    return ev.weighted_metrics(scored_test(spark, sf))


def q_auc_exact(spark, sf):
    return ev.auc_exact(scored_test(spark, sf), LABEL_COLUMN, "margin")


def q_auc_histogram(spark, sf):
    """E1 from mergeable histograms: bounds of the area and its middle, from two batches' bins added up."""
    scored = scored_test(spark, sf)
    batch = F.pmod(F.xxhash64(KEY_COLUMN), F.lit(2))
    bins = ev.merge_histograms(*[ev.score_histogram(scored.filter(batch == k), LABEL_COLUMN) for k in (0, 1)])
    return ev.auc_bounds(bins)


def q_roc_curve(spark, sf):
    return ev.roc_points(scored_test(spark, sf), LABEL_COLUMN, "margin")


# ----------------------------------------------------------- model queries
def _model_frames(spark, sf, seed=ml.MODEL_SEED, ratio=ml.MODEL_TRAIN_RATIO, features=FEATURE_COLUMNS):
    frame = ml.assemble_features(churn_features(spark, sf), features, ml.FEATURES_VECTOR)
    return ml.model_frames(frame, KEY_COLUMN, ratio, seed)


def _tuned(spark, sf, names, grids: dict | None = None) -> tuple[dict[str, CrossValidatorModel], DataFrame, DataFrame]:
    """Tuned models by name (full grids unless given), with the training and test rows behind them."""
    train, test = _model_frames(spark, sf)
    wanted = {name: (grids or {}).get(name) or ml.MODELS[name][1] for name in names}
    return tuning.tuned_models(train, wanted, KEY_COLUMN, LABEL_COLUMN), train, test


def _test_metrics_row(spark, model_name, cv_model, test) -> DataFrame:
    """Best setting, its CV metric, and test-set AUC plus confusion metrics.

    The test metrics are one-row distributed aggregates; their single rows
    are assembled into the result row on the driver (bounded size).
    """
    pred = cv_model.transform(test)
    best = int(max(range(len(cv_model.avgMetrics)), key=lambda i: cv_model.avgMetrics[i]))
    auc = round(ev.exact_auc_evaluator(LABEL_COLUMN).evaluate(pred), 6)
    conf = ev.confusion_metrics(pred).first().asDict()
    row = {"model": model_name, "settings": len(cv_model.avgMetrics),
           "best_params": ml.describe_params(cv_model.getEstimatorParamMaps()[best]),
           "cv_auc": float(cv_model.avgMetrics[best]), "test_auc": auc, **conf}
    schema = ("model string, settings int, best_params string, cv_auc double, test_auc double, tn bigint, "
              "fp bigint, fn bigint, tp bigint, accuracy double, positive_precision double, "
              "positive_recall double, positive_f1 double")
    return spark.createDataFrame([row], schema)


def tuned_report(spark, sf, model_name: str, grid: dict | None = None) -> DataFrame:
    """Search the full grid (or ``grid``) by 5-fold CV and test the best model."""
    models, train, test = _tuned(spark, sf, [model_name], {model_name: grid})
    out = _test_metrics_row(spark, model_name, models[model_name], test)
    train.unpersist()
    return out


def cv_leaderboard(spark, sf, grids: dict | None = None) -> DataFrame:
    """Every setting of all four models (or of ``grids``) with its fold metrics, from the ledger."""
    train, _ = _model_frames(spark, sf)
    wanted = {name: (grids or {}).get(name) or ml.MODELS[name][1] for name in MODEL_NAMES}
    found = tuning.search(train, wanted, KEY_COLUMN, LABEL_COLUMN)
    train.unpersist()
    rows = [row for name in MODEL_NAMES for row in tuning.leaderboard(found[name])]
    return spark.createDataFrame(rows, "model string, setting int, params string, "
                                       "avg_auc double, std_auc double")


def logreg_coefficients(spark, sf, grid: dict | None = None) -> DataFrame:
    """Coefficients of the best logistic model."""
    models, train, _ = _tuned(spark, sf, ["logreg"], {"logreg": grid})
    train.unpersist()
    return spark.createDataFrame(ml.coefficient_rows(models["logreg"].bestModel, FEATURE_COLUMNS),
                                 "term string, coefficient double")


def _univariate_scored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """One default logistic fit per feature on a 70/30 split; the (training, test) rows as each
    model scores them, one row per feature and row: feature, label, score (the margin), prediction.

    The fits are independent and submitted together; each is itself a distributed job.
    """
    frame = ml.stable_training_frame(churn_features(spark, sf), KEY_COLUMN)
    train_all, test_all = ml.split_train_test(frame, KEY_COLUMN, ml.UNIVARIATE_TRAIN_RATIO, ml.UNIVARIATE_SEED)

    def one(feature):
        vec = f"{feature}_vector"
        train, test = (ml.assemble_features(rows.select(feature, LABEL_COLUMN), [feature], vec, True)
                       for rows in (train_all, test_all))
        model = ml.logistic_regression(vec, LABEL_COLUMN).fit(train)
        return [model.transform(rows).select(F.lit(feature).alias("feature"), LABEL_COLUMN,
                                             ev.positive_score().alias("score"), "prediction") for rows in (train, test)]

    with tuning.JobPool(spark, len(FEATURE_COLUMNS)) as pool:
        scored = list(pool.run([lambda f=f: one(f) for f in FEATURE_COLUMNS]))
    frame.unpersist()
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*scored))


def q_univariate_report(spark, sf):
    """AUC and weighted metrics of each one-feature model on its test rows, from two keyed aggregates."""
    def build():
        _, test = _univariate_scored(spark, sf)
        test = shared_table(test, "univariate-test")
        auc = ev.auc_exact(test, LABEL_COLUMN, "score", by=["feature"])
        return auc.join(ev.weighted_metrics(test, LABEL_COLUMN, by=["feature"]), "feature")
    return settled(spark, build, "univariate-report")


def q_univariate_roc(spark, sf):
    """E8 per feature: the ROC curves of the six one-feature models on their training rows, in one pass."""
    def build():
        train, _ = _univariate_scored(spark, sf)
        return ev.roc_curves(shared_table(train, "univariate-train"), ["feature"], LABEL_COLUMN, "score")
    return settled(spark, build, "univariate-roc")


def q_univariate_check(spark, sf):
    """M4/T1 in figures: per feature, training and test rows, training positives, and whether
    the unregularised fit's mean residual is near zero, as its gradient demands."""
    def build():
        train, test = _univariate_scored(spark, sf)
        residual = F.col(LABEL_COLUMN) - 1 / (1 + F.exp(-F.col("score")))
        fits = train.groupBy("feature").agg(
            F.count(F.lit(1)).alias("train_rows"), F.count_if(F.col(LABEL_COLUMN) == 1).alias("train_positives"),
            (F.abs(F.avg(residual)) < 1e-3).alias("gradient_near_zero"))
        return fits.join(test.groupBy("feature").agg(F.count(F.lit(1)).alias("test_rows")), "feature")
    return settled(spark, build, "univariate-check")


def tuned_training_roc(spark, sf, grid: dict | None = None) -> DataFrame:
    """E8 as the original reads it: ROC of the best logistic model's training
    summary, with the training rows and positives behind it."""
    models, train, _ = _tuned(spark, sf, ["logreg"], {"logreg": grid})
    roc = models["logreg"].bestModel.evaluate(train).roc.select(F.col("FPR").alias("fpr"), F.col("TPR").alias("tpr"))
    out = shared_table(roc, "training-roc")
    train.unpersist()
    return out


def model_save_load_score(spark, sf, grids: dict | None = None) -> DataFrame:
    """Save each tuned model under <checkpoint>/models/<name>/<stamp>, reload the latest and score.

    One row per model and test row; ``same`` says that the reloaded model scores as the tuned one did.
    """
    models, train, test = _tuned(spark, sf, MODEL_NAMES, grids)
    train.unpersist()
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/models"
    out = None
    for name, cv_model in models.items():
        save_model(cv_model, root, name)
        reloaded = load_latest(root, name, CrossValidatorModel)
        p = vector_to_array("probability")[1]
        before = cv_model.transform(test).select(F.col(KEY_COLUMN).alias("_key"), p.alias("_before"))
        scored = reloaded.transform(test).select(KEY_COLUMN, LABEL_COLUMN, "prediction", p.alias("_p"))
        scored = scored.join(before, F.col(KEY_COLUMN) == F.col("_key")).select(
            F.lit(name).alias("model"), KEY_COLUMN, LABEL_COLUMN, "prediction",
            F.round("_p", 6).alias("probability"), (F.col("_p") == F.col("_before")).alias("same"))
        out = scored if out is None else out.unionByName(scored)
    return out


def q_model_reload_check(spark, sf):
    """S6/S7 in figures: per model, test rows, positives and scores that changed by saving."""
    return model_save_load_score(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col(LABEL_COLUMN) == 1).alias("positives"),
        F.count_if(~F.col("same")).alias("changed"))


def q_tuning_check(spark, sf, grids: dict | None = None):
    """T2-T7 in figures: per model, settings tried, the confusion counts' sums on the test rows, and whether
    the reported test AUC is the rank-sum area of the scored rows (all models ranked in one pass)."""
    models, train, test = _tuned(spark, sf, MODEL_NAMES, grids)
    train.unpersist()
    score = vector_to_array("rawPrediction")[1]
    scored = reduce(DataFrame.unionByName, [
        m.transform(test).select(F.lit(name).alias("model"), LABEL_COLUMN, score.alias("score")) for name, m in models.items()])
    areas = ev.auc_exact(scored, LABEL_COLUMN, "score", by=["model"])
    reports = reduce(DataFrame.unionByName, [_test_metrics_row(spark, name, m, test) for name, m in models.items()])
    return reports.join(areas, "model").select(
        "model", "settings", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("test_rows"),
        (F.col("fn") + F.col("tp")).alias("positives"), (F.abs(F.col("auc") - F.col("test_auc")) < 2e-6).alias("auc_agrees"))


MODEL_QUERIES = {
    "assemble_features": q_assemble_features,
    "scale_features": q_scale_features,
    "split_train_test": q_split_train_test,
    "logreg_score": q_logreg_score,
    "confusion_metrics": q_confusion_metrics,
    "confusion_cells": q_confusion_cells,
    "weighted_metrics": q_weighted_metrics,
    "auc_exact": q_auc_exact,
    "auc_histogram": q_auc_histogram,
    "roc_curve": q_roc_curve,
    "univariate_report": q_univariate_report,
    "univariate_check": q_univariate_check,
    "univariate_roc": q_univariate_roc,
    "logreg_cv": lambda spark, sf: tuned_report(spark, sf, "logreg"),
    "dtree_cv": lambda spark, sf: tuned_report(spark, sf, "dtree"),
    "rforest_cv": lambda spark, sf: tuned_report(spark, sf, "rforest"),
    "gbt_cv": lambda spark, sf: tuned_report(spark, sf, "gbt"),
    "tuning_check": q_tuning_check,
    "cv_leaderboard": cv_leaderboard,
    "logreg_coefficients": logreg_coefficients,
    "training_roc": tuned_training_roc,
    "model_save_load_score": model_save_load_score,
    "model_reload_check": q_model_reload_check,
}


# ------------------------------------------------------------------ oracles
def _bucket_sql(seed: int, buckets: int = 1000) -> str:
    return (f"(CAST('0x' || substr(md5(concat('{seed}:', CAST(orderatom_orderatomid AS VARCHAR))), 1, 8) "
            f"AS BIGINT) % {buckets})")


_CUT = int(round(ml.MODEL_TRAIN_RATIO * 1000))
_SCORED = (f"SELECT *, round(1 / (1 + exp(-margin)), 6) AS probability, "
           f"CASE WHEN margin > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS prediction FROM "
           f"(SELECT *, round({margin_sql()}, 6) AS margin FROM features "
           f"WHERE {_bucket_sql(ml.MODEL_SEED)} >= {_CUT}) t")


def _on_scored(select: str) -> str:
    return osql.with_ctes(select, "features", local=[("scored", _SCORED)])


_CONF = ("SELECT CAST(count_if(cancelled = 0 AND prediction = 0) AS BIGINT) AS tn, "
         "CAST(count_if(cancelled = 0 AND prediction = 1) AS BIGINT) AS fp, "
         "CAST(count_if(cancelled = 1 AND prediction = 0) AS BIGINT) AS fn, "
         "CAST(count_if(cancelled = 1 AND prediction = 1) AS BIGINT) AS tp FROM scored")


def _ratio(n, d):
    return f"CASE WHEN ({d}) <> 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"


def _confusion_metrics_sql() -> str:
    p, r = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
    f1 = _ratio(f"2 * ({p}) * ({r})", f"({p}) + ({r})")
    acc = "CASE WHEN tn + fp + fn + tp <> 0 THEN CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp) END"
    return osql.with_ctes(
        f"SELECT tn, fp, fn, tp, round({acc}, 6) AS accuracy, round({p}, 6) AS positive_precision, "
        f"round({r}, 6) AS positive_recall, round({f1}, 6) AS positive_f1 FROM c",
        "features", local=[("scored", _SCORED), ("c", _CONF)])


def _pct_sql(c, t):
    b = f"CAST(floor(({c} * 20000 + {t}) / ({t} * 2)) AS BIGINT)"
    return f"CAST({b} // 100 AS VARCHAR) || '.' || lpad(CAST({b} % 100 AS VARCHAR), 2, '0') || '%'"


def _confusion_cells_sql() -> str:
    cells = [("True Neg", "tn"), ("False Pos", "fp"), ("False Neg", "fn"), ("True Pos", "tp")]
    total = "(tn + fp + fn + tp)"
    parts = [f"SELECT '{name}' AS cell_name, {col} AS cell_count, {_pct_sql(col, total)} AS cell_percent, "
             f"'{name}' || chr(10) || CAST({col} AS VARCHAR) || chr(10) || {_pct_sql(col, total)} "
             f"AS cell_label FROM c" for name, col in cells]
    return osql.with_ctes("\nUNION ALL ".join(parts), "features",
                          local=[("scored", _SCORED), ("c", _CONF)])


_WEIGHTED_COUNTS = "count(*) AS n, " + ", ".join(
    f"count_if(cancelled = {k} AND prediction = {k}) AS tp{k}, count_if(prediction = {k}) AS pred{k}, "
    f"count_if(cancelled = {k}) AS label{k}" for k in (0, 1))


def _weighted_columns() -> str:
    prec = {k: _ratio(f"tp{k}", f"pred{k}") for k in (0, 1)}
    rec = {k: _ratio(f"tp{k}", f"label{k}") for k in (0, 1)}
    f1 = {k: _ratio(f"2 * ({prec[k]}) * ({rec[k]})", f"({prec[k]}) + ({rec[k]})") for k in (0, 1)}
    w = {k: _ratio(f"label{k}", "n") for k in (0, 1)}

    def weighted(parts):
        return "0.0 + " + " + ".join(f"({w[k]}) * ({parts[k]})" for k in (0, 1))

    return (f"round({_ratio('tp0 + tp1', 'n')}, 6) AS accuracy, "
            f"round({weighted(prec)}, 6) AS weighted_precision, round({weighted(rec)}, 6) AS weighted_recall, "
            f"round({weighted(f1)}, 6) AS weighted_f1")


def _weighted_sql() -> str:
    return osql.with_ctes(f"SELECT {_weighted_columns()} FROM a", "features",
                          local=[("scored", _SCORED), ("a", f"SELECT {_WEIGHTED_COUNTS} FROM scored")])


_PER_SCORE = ("SELECT margin AS score, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg "
              "FROM scored GROUP BY margin")

_TEST_ROWS = f"SELECT * FROM features WHERE {_bucket_sql(ml.MODEL_SEED)} >= {_CUT}"


def _settings(grid: dict) -> int:
    n = 1
    for values in grid.values():
        n *= len(values)
    return n


def _per_model(select: str) -> str:
    """``select`` over the test rows, once a model with its number of settings."""
    models = ", ".join(f"('{name}', {_settings(ml.MODELS[name][1])})" for name in MODEL_NAMES)
    return osql.with_ctes(f"SELECT model, {select} FROM test_rows, (VALUES {models}) AS m(model, settings) "
                          "GROUP BY model, settings", "features", local=[("test_rows", _TEST_ROWS)])


_UNIVARIATE_CUT = int(round(ml.UNIVARIATE_TRAIN_RATIO * 1000))
_FEATURE_VALUES = ", ".join(f"('{c}')" for c in FEATURE_COLUMNS)
# One row per feature and order atom: the feature's value and whether the row is a training row.
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, cancelled, "
    f"{_bucket_sql(ml.UNIVARIATE_SEED)} < {_UNIVARIATE_CUT} AS train FROM features" for c in FEATURE_COLUMNS)
# A one-feature logistic fit slopes the way the feature and the label vary together.
_SLOPE = ("SELECT feature, CASE WHEN covar_pop(x, cancelled) < 0 THEN -1 ELSE 1 END AS slope "
          "FROM long WHERE train GROUP BY feature")


def _univariate_roc_sql() -> str:
    return osql.with_ctes(
        "SELECT feature, CAST(tp + fp AS BIGINT) AS accepted, round(CAST(fp AS DOUBLE) / n_all, 6) AS fpr, "
        "round(CAST(tp AS DOUBLE) / p_all, 6) AS tpr FROM r "
        "UNION ALL SELECT DISTINCT feature, CAST(0 AS BIGINT), 0.0, 0.0 FROM long", "features",
        local=[("long", _LONG), ("slope", _SLOPE),
               ("per", "SELECT feature, slope * x AS score, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg "
                       "FROM long JOIN slope USING (feature) WHERE train GROUP BY ALL"),
               ("r", "SELECT feature, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY feature) "
                     "AS p_all, sum(neg) OVER (PARTITION BY feature) AS n_all FROM per "
                     "WINDOW w AS (PARTITION BY feature ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")])


def _univariate_report_sql(steps: int = 12) -> str:
    """Newton's method on the training rows, a fixed number of steps (it has converged long before),
    then the metrics of the test rows."""
    scaled = ("SELECT l.feature, (x - m) / s AS z, cancelled, train FROM long l JOIN (SELECT feature, avg(x) AS m, "
              "CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM long WHERE train GROUP BY feature) k "
              "USING (feature)")
    ctes = [("long", _LONG), ("scaled", scaled),
            ("b0", "SELECT DISTINCT feature, CAST(0 AS DOUBLE) AS c0, CAST(0 AS DOUBLE) AS c1 FROM long")]
    for k in range(steps):
        sums = (f"SELECT feature, any_value(c0) AS c0, any_value(c1) AS c1, sum(cancelled - p) AS g0, "
                f"sum((cancelled - p) * z) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, "
                f"sum(p * (1 - p) * z * z) AS h11 FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * z))) AS p "
                f"FROM scaled JOIN b{k} USING (feature) WHERE train) t GROUP BY feature")
        ctes.append((f"b{k + 1}", f"SELECT feature, c0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS c0, "
                                  f"c1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS c1 FROM ({sums}) s"))
    ctes += [("scored", f"SELECT feature, cancelled, c0 + c1 * z AS score, CASE WHEN c0 + c1 * z > 0 THEN 1 ELSE 0 END "
                        f"AS prediction FROM scaled JOIN b{steps} USING (feature) WHERE NOT train"),
             ("a", f"SELECT feature, {_WEIGHTED_COUNTS} FROM scored GROUP BY feature"),
             ("per", "SELECT feature, score, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg FROM scored GROUP BY ALL"),
             ("r", "SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS nb FROM per"),
             ("u", "SELECT feature, round(sum(pos * (nb + CAST(neg AS DOUBLE) / 2)) / "
                   "(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM r GROUP BY feature")]
    return osql.with_ctes(f"SELECT feature, auc, {_weighted_columns()} FROM a JOIN u USING (feature)", "features", local=ctes)


MODEL_ORACLES = {
    "univariate_check": osql.with_ctes(
        "SELECT feature, CAST(count_if(train) AS BIGINT) AS train_rows, "
        "CAST(count_if(train AND cancelled = 1) AS BIGINT) AS train_positives, "
        "CAST(count_if(NOT train) AS BIGINT) AS test_rows, true AS gradient_near_zero "
        f"FROM (SELECT cancelled, {_bucket_sql(ml.UNIVARIATE_SEED)} < {_UNIVARIATE_CUT} AS train FROM features) t, "
        f"(VALUES {_FEATURE_VALUES}) AS f(feature) GROUP BY feature", "features"),
    "tuning_check": _per_model("settings, count(*) AS test_rows, CAST(count_if(cancelled = 1) AS BIGINT) AS positives, "
                               "true AS auc_agrees"),
    "univariate_report": _univariate_report_sql(),
    "univariate_roc": _univariate_roc_sql(),
    "model_reload_check": _per_model("count(*) AS test_rows, CAST(count_if(cancelled = 1) AS BIGINT) AS positives, "
                                     "CAST(0 AS BIGINT) AS changed"),
    "assemble_features": osql.with_ctes(
        "SELECT orderatom_orderatomid, " + ", ".join(f"CAST({c} AS DOUBLE) AS vec_{c}"
                                                     for c in FEATURE_COLUMNS) + " FROM features",
        "features"),
    "scale_features": osql.with_ctes(
        "SELECT orderatom_orderatomid, " + ", ".join(
            f"round(CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0 ELSE {c} / stddev_samp({c}) OVER () END, 6) "
            f"AS scaled_{c}" for c in FEATURE_COLUMNS) + " FROM features", "features"),
    "split_train_test": osql.with_ctes(
        f"SELECT orderatom_orderatomid, cancelled, CASE WHEN {_bucket_sql(ml.MODEL_SEED)} < {_CUT} "
        f"THEN 'train' ELSE 'test' END AS split FROM features", "features"),
    "logreg_score": _on_scored(
        "SELECT orderatom_orderatomid, cancelled, margin, probability, prediction FROM scored"),
    "confusion_metrics": _confusion_metrics_sql(),
    "confusion_cells": _confusion_cells_sql(),
    "weighted_metrics": _weighted_sql(),
    "auc_exact": osql.with_ctes(
        "SELECT round(sum(pos * (coalesce(nb, 0) + CAST(neg AS DOUBLE) / 2)) / "
        "(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM r",
        "features", local=[("scored", _SCORED), ("per", _PER_SCORE),
                           ("r", "SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED "
                                 "PRECEDING AND 1 PRECEDING) AS nb FROM per")]),
    "auc_histogram": osql.with_ctes(
        "SELECT round(sure / pairs, 6) AS auc_low, round((sure + same) / pairs, 6) AS auc_high, "
        "round((sure / pairs + (sure + same) / pairs) / 2, 6) AS auc FROM (SELECT sum(pos * coalesce(nb, 0)) AS sure, sum(pos * neg) AS same, "
        "CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) AS pairs FROM r) t",
        "features", local=[("scored", _SCORED),
                           ("per", f"SELECT least(floor(probability * {ev.HISTOGRAM_BINS}), {ev.HISTOGRAM_BINS - 1}) AS bin, "
                                   "count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg FROM scored GROUP BY 1"),
                           ("r", "SELECT *, sum(neg) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED "
                                 "PRECEDING AND 1 PRECEDING) AS nb FROM per")]),
    "roc_curve": osql.with_ctes(
        f"SELECT score AS threshold, round({_ratio('fp_ge', 'n_all')}, 6) AS fpr, "
        f"round({_ratio('tp_ge', 'p_all')}, 6) AS tpr FROM r",
        "features", local=[("scored", _SCORED), ("per", _PER_SCORE),
                           ("r", "SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN "
                                 "UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge, sum(neg) OVER "
                                 "(ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                                 "AS fp_ge, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all FROM per")]),
}
