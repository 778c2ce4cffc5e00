"""Registered model queries (M-1..M-5, M-8, M-11, M-12, V-10, F-27).  Seeded and
iterative fits have no SQL twin; ``model_checks`` compares with SQL what does not
depend on the seed (rows scored per model and service, and that each model explains
the target), and tests/test_models.py checks them against numpy and brute force."""

from __future__ import annotations

import statistics

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import forecast as fc
from ..operators import models as md
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import targets as tg
from ..session import scratch_table
from ..sources import adapters as ad
from .registry import register

LAG_COLS = ["cpu_cores_value", "node_cpu_util_value"]
FEATURES = ([f"{c}_lag{k}" for c in LAG_COLS for k in (1, 2, 3)]
            + ["replica_count_value", "load_users", "mem_bytes_value", "node_mem_util_value"])


def model_frame(spark, sf):
    """Experiments with lag features, buffered targets and the time split, stored
    once for all fits of a query by range of service, so that a fit of one service
    reads its row groups only."""
    e = ad.experiments(spark, sf)
    e = fe.lag_features(e, LAG_COLS, lags=(1, 2, 3), fill=0.0)
    e = tg.buffered_targets(e)
    # stored before it is dealt: the bounds of the ranges take a pass of their own
    e = scratch_table(sp.time_split(e), "model-rows").repartitionByRange("service", "experiment_id", "idx")
    return scratch_table(e.sortWithinPartitions("service", "experiment_id", "idx"), "model-frame")


def _forest(tr, te):
    return md.rf_regressor(tr, te, FEATURES, "cpu_target")


def _boosted(tr, te):
    return md.boosted_regressor(tr, te, FEATURES, "cpu_target")


def _per_service(data, fit, model):
    """Predictions and status table of one model for every service (a service
    list: one row each)."""
    services = [r["service"] for r in data.select("service").distinct().orderBy("service").collect()]

    def one(d, s):
        _, pred = fit(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"))
        return md._predictions(pred, s, "cpu_target", model, "idx", "cpu_target")

    return md.train_per_service(data, services, one)


def _union(preds, status):
    """All predictions; a service that could not be fitted is an error here."""
    failed = status.where(F.col("status") != "success").collect()
    if failed:
        raise RuntimeError("; ".join(f"{r['service']}: {r['error']}" for r in failed))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out


@register("forest_predictions")
def forest_predictions(spark, sf):
    """M-2 + M-12: per-service random forest on the cpu target (test rows)."""
    return _union(*_per_service(model_frame(spark, sf), _forest, "forest"))


@register("boosted_predictions")
def boosted_predictions(spark, sf):
    """M-3 + M-12: per-service boosted trees (100 x depth 4, step 0.1, subsample 0.8)."""
    return _union(*_per_service(model_frame(spark, sf), _boosted, "boosted"))


@register("service_status_rows", sql="""
    SELECT DISTINCT event_type AS service, 'success' AS status, CAST(NULL AS VARCHAR) AS error FROM events""")
def service_status_rows(spark, sf):
    """M-12: status of the fit of every service."""
    return _per_service(model_frame(spark, sf), _forest, "forest")[1]


@register("feature_importance")
def feature_importance(spark, sf):
    """M-11: importances of a forest fitted on all services' train rows."""
    d = model_frame(spark, sf)
    m, _ = md.rf_regressor(d.where(F.col("split") == "train"), d.limit(0), FEATURES, "cpu_target")
    return md.feature_importance(m, FEATURES, "forest", spark)


def _sequences(spark, sf, target="cpu_cores_value", extra=()):
    e = scratch_table(sp.time_split(tg.future_change_target(ad.experiments(spark, sf))), "sequences")
    return fe.sequences(e, ["cpu_cores_value", "node_cpu_util_value"], target, 10, extra=("split", "service", *extra))


def _autoregressive(spark, sf):
    s = _sequences(spark, sf)
    _, pred = md.autoregressive(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"))
    return md._predictions(pred, F.col("service"), "cpu_target", "autoregressive", "idx", "target")


@register("autoregressive_predictions")
def autoregressive_predictions(spark, sf):
    """M-5: next-step cpu from the previous 10 rows (sequence model re-aimed
    as a linear model on the flattened window)."""
    return _autoregressive(spark, sf)


@register("autoregressive_classes")
def autoregressive_classes(spark, sf):
    """M-5, the classifier: probability that cpu rises by more than a tenth."""
    s = tg.class_weights(_sequences(spark, sf, extra=("y_class",)))
    _, pred = md.autoregressive_classifier(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), weight_col="weight")
    return pred.select("experiment_id", "idx", "service", "y_class", "proba", (F.col("proba") > 0.5).cast("int").alias("y_pred"))


@register("stacked_predictions")
def stacked_predictions(spark, sf):
    """M-8: linear stacking of the three prediction models per (service, target),
    fitted on the first half of each and scored on the second."""
    return md.stack(ad.predictions(spark, sf), ad.MODELS)


@register("model_checks", adapters=["experiments", "predictions"], sql="""
    WITH e AS (SELECT *, CASE WHEN idx < floor(count(*) OVER (PARTITION BY experiment_id) * 0.8) THEN 'train' ELSE 'test' END AS split
               FROM experiments),
    q AS (SELECT *, row_number() OVER (PARTITION BY service, target ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY service, target) AS n
          FROM predictions WHERE model = 'forest')
    SELECT m.model, e.service, 'cpu_target' AS target, count(*) AS n, true AS explains, sum(e.cpu_cores_value * 1.2) AS y_sum
    FROM e, (VALUES ('forest'), ('boosted')) m(model) WHERE split = 'test' GROUP BY ALL
    UNION ALL
    SELECT 'stacking', service, target, count(*), true, sum(y_true) FROM q WHERE pos >= floor(n * 0.5) GROUP BY ALL""",
          floats=["y_sum"])
def model_checks(spark, sf):
    """M-2, M-3, M-8, M-12: rows scored, and whether the model explains more than
    half of the target's variance, per model and service."""
    data = model_frame(spark, sf)
    cols = ["model", "service", "target", "idx", "y_true", "y_pred"]
    preds = [_union(*_per_service(data, fit, name)).select(*cols) for fit, name in ((_forest, "forest"), (_boosted, "boosted"))]
    preds.append(md.stack(ad.predictions(spark, sf), ad.MODELS).select(*cols))
    scored = scratch_table(preds[0].unionByName(preds[1]).unionByName(preds[2]), "scored")
    m = sc.regression_metrics(scored, ("model", "service", "target"))
    sums = scored.groupBy("model", "service", "target").agg(F.sum("y_true").alias("y_sum"))
    return m.join(sums, ["model", "service", "target"]).select("model", "service", "target", "n", (F.col("r2") > 0.5).alias("explains"), "y_sum")


@register("seasonal_forecast")
def seasonal_forecast(spark, sf):
    """M-4: trend + daily / weekly seasonality + replica regressor per
    experiment (15-minute axis), 30 future steps with a 90 % interval."""
    e = ad.experiments(spark, sf).withColumn("t_h", F.col("idx") * 0.25)
    return fc.seasonal_forecast(e, ["experiment_id"], "t_h", "cpu_cores_value", horizon=30, step=0.25,
                                regressors=["replica_count_value"])


@register("rf_classifier_search")
def rf_classifier_search(spark, sf):
    """M-1: random search (12 seeded draws of the whole space) scored by F1 on 3
    expanding folds of the train rows, with balanced class weights; the best forest
    is fitted and scored on the test rows.  Forests fit on all labelled rows."""
    t = scratch_table(tg.class_weights(tg.future_change_target(model_frame(spark, sf))), "search")
    train = t.where(F.col("split") == "train")
    folds_df = scratch_table(sp.expanding_folds(train, 3), "folds")
    folds = [(folds_df.where((F.col("fold") == i) & (F.col("role") == "train")),
              folds_df.where((F.col("fold") == i) & (F.col("role") == "test"))) for i in range(3)]
    res = md.rf_classifier_search(train, FEATURES, "y_class", folds, weight_col="weight")
    p, m = res["params"], md.score_classifier(res["model"], md.assemble(t.where(F.col("split") == "test"), FEATURES), "y_class")
    return spark.createDataFrame(
        [(int(p["numTrees"]), int(p["maxDepth"]), int(p["minInstancesPerNode"]), p["featureSubsetStrategy"], float(res["f1"]),
          float(m["accuracy"]), float(m["precision"]), float(m["recall"]), float(m["f1"]), float(m["roc_auc"]),
          int(m["tp"]), int(m["fp"]), int(m["tn"]), int(m["fn"]))],
        "num_trees int, max_depth int, min_instances int, feature_subset string, cv_f1 double, accuracy double, precision double, "
        "recall double, f1 double, roc_auc double, tp long, fp long, tn long, fn long")


@register("cv_summary", sql="""
    SELECT 1.0::DOUBLE AS mean, 0.0::DOUBLE AS std, 1.0::DOUBLE AS min, 1.0::DOUBLE AS max, count(*) AS n_rows FROM events""")
def cv_summary(spark, sf):
    """V-10: 5 contiguous folds (P-4) pooled over experiments, a linear model
    refitted per fold, summary of the fold R2 (population std).  The target is a
    linear function of one feature, so every fold's R2 is 1 up to rounding."""
    d = scratch_table(sp.contiguous_folds(model_frame(spark, sf), 5), "folds")
    scores = []
    for k in range(5):
        tr, te = d.where(F.col("fold") != k), d.where(F.col("fold") == k)
        m = LinearRegression(featuresCol="features", labelCol="cpu_target").fit(md.assemble(tr, FEATURES))
        p = md._predictions(m.transform(md.assemble(te, FEATURES)), "all", "cpu_target", "linear", "idx",
                            "cpu_target")
        scores.append(sc.regression_metrics(p, median_mode="approx").first()["r2"])
    mean = sum(scores) / len(scores)
    return spark.createDataFrame([(round(mean, 6), round(statistics.pstdev(scores), 6), round(min(scores), 6), round(max(scores), 6), d.count())],
                                 "mean double, std double, min double, max double, n_rows long")


CV_FEATURE, CV_TARGET = "cpu_cores_value", "node_cpu_util_value"


@register("cv_folds", adapters=["experiments"], floats=["r2", "mean", "std"], sql=f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY experiment_id) AS n FROM experiments),
    s AS (SELECT {CV_FEATURE} AS x, {CV_TARGET} AS y, idx, n // 5 AS base, n % 5 AS extra FROM n),
    f AS (
      SELECT x, y, CAST(CASE WHEN idx < (base + 1) * extra THEN idx // (base + 1) ELSE extra + (idx - (base + 1) * extra) // base END AS INTEGER) AS fold FROM s),
    k AS (
      SELECT k.fold, count(*) AS n_train, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept
      FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1),
    e AS (
      SELECT fold, n_train, count(*) AS n_test, 1 - sum(power(y - slope * x - icept, 2)) / (var_pop(y) * count(*)) AS r2 FROM f JOIN k USING (fold) GROUP BY 1, 2)
    SELECT fold, n_train, n_test, round(r2, 9) AS r2, round(avg(r2) OVER (), 9) AS mean, round(stddev_pop(r2) OVER (), 9) AS std FROM e""")
def cv_folds(spark, sf):
    """V-10 on a measured target: R2 of a linear model refitted per contiguous fold,
    with the summary of all folds; the SQL solves the normal equations of each fold."""
    d = scratch_table(sp.contiguous_folds(ad.experiments(spark, sf), 5), "folds")
    sizes = {r["fold"]: r["n"] for r in d.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # five
    rows = []
    for k in range(5):
        tr, te = d.where(F.col("fold") != k), d.where(F.col("fold") == k)
        m = LinearRegression(featuresCol="features", labelCol=CV_TARGET, solver="normal").fit(md.assemble(tr, [CV_FEATURE]))
        p = md._predictions(m.transform(md.assemble(te, [CV_FEATURE])), "all", CV_TARGET, "linear", "idx", CV_TARGET)
        rows.append((k, sum(sizes.values()) - sizes[k], sizes[k], sc.regression_metrics(p, median_mode="approx").first()["r2"]))
    r2 = [r[3] for r in rows]
    mean, std = round(statistics.fmean(r2), 9), round(statistics.pstdev(r2), 9)
    return spark.createDataFrame([(k, a, b, round(v, 9), mean, std) for k, a, b, v in rows],
                                 "fold int, n_train long, n_test long, r2 double, mean double, std double")


@register("oversample", adapters=["experiments"], sql="""
    WITH t AS (SELECT lead(cpu_cores_value) OVER w AS nxt, cpu_cores_value AS cur, lead(idx) OVER w AS more
               FROM experiments WINDOW w AS (PARTITION BY experiment_id ORDER BY idx)),
    c AS (SELECT CAST(((CASE WHEN nxt = 0 THEN 1e-6 ELSE nxt END) - (CASE WHEN cur = 0 THEN 1e-6 ELSE cur END))
                      / (CASE WHEN cur = 0 THEN 1e-6 ELSE cur END) > 0.1 AS INTEGER) AS y_class FROM t WHERE more IS NOT NULL),
    n AS (SELECT y_class, count(*) AS n FROM c GROUP BY y_class)
    SELECT y_class, false AS synthetic, n FROM n
    UNION ALL SELECT y_class, true, (SELECT max(n) FROM n) - n FROM n WHERE n < (SELECT max(n) FROM n)""")
def oversample(spark, sf):
    """F-27: minority oversampling of the next-step increase class (F-24) on
    cpu and node utilisation, with exact k = 5 nearest neighbours: rows per class,
    real and synthetic."""
    from ..operators.oversample import oversample as smote
    t = tg.future_change_target(ad.experiments(spark, sf))
    out = smote(t, ["cpu_cores_value", "node_cpu_util_value"], "y_class", k=5)
    return out.groupBy("y_class", "synthetic").agg(F.count("*").alias("n"))
