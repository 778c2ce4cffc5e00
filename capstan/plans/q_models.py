"""Registered queries: scoring (V-1..V-9), grading / compliance (V-11..V-23)
and ensembles (M-6, M-7, M-9, M-10) over the ``predictions`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as en
from ..operators import grading as gr
from ..operators import scoring as sc
from ..sources import adapters as ad
from .registry import register

_REG_FLOATS = ["mse", "rmse", "mae", "mape", "r2", "explained_variance", "max_error",
               "median_absolute_error", "smape", "mape_log", "wmape"]


def _metrics_sql(src: str = "predictions", keys: str = "service, target, model") -> str:
    return f"""
    SELECT {keys}, count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
           avg(abs(e) / greatest(abs(y_true), 2.220446049250313e-16)) AS mape,
           CASE WHEN var_pop(y_true) = 0 THEN (CASE WHEN sum(e * e) = 0 THEN 1.0 ELSE 0.0 END)
                ELSE 1 - sum(e * e) / (var_pop(y_true) * count(*)) END AS r2,
           CASE WHEN var_pop(y_true) = 0 THEN (CASE WHEN var_pop(e) = 0 THEN 1.0 ELSE 0.0 END)
                ELSE 1 - var_pop(e) / var_pop(y_true) END AS explained_variance,
           max(abs(e)) AS max_error, quantile_cont(abs(e), 0.5) AS median_absolute_error,
           avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN NULL
                    ELSE 2 * abs(e) / (abs(y_true) + abs(y_pred)) END) * 100 AS smape,
           avg(abs(ln(1 + y_true) - ln(1 + y_pred))) * 100 AS mape_log,
           sum(abs(e)) / sum(abs(y_true)) * 100 AS wmape
    FROM (SELECT *, y_pred - y_true AS e FROM {src}) s GROUP BY {keys}"""


def _grade_sql(r2: str, mape: str, ladder=gr.LADDER_SEVEN) -> str:
    arms = " ".join(f"WHEN {r2} > {r} AND {mape} < {m} THEN '{g}'" for g, r, m in ladder)
    return f"(CASE {arms} ELSE 'D' END)"


def _metrics(spark, sf):
    return sc.regression_metrics(ad.predictions(spark, sf))


@register("regression_metrics", adapters=["predictions"], floats=_REG_FLOATS, sql=_metrics_sql())
def regression_metrics(spark, sf):
    """V-1..V-5: every regression metric per (service, target, model)."""
    return _metrics(spark, sf)


@register("directional_accuracy", adapters=["predictions"], floats=["directional_accuracy"], sql="""
    SELECT service, target, model, coalesce(avg(agree), 0.0) AS directional_accuracy FROM (
      SELECT service, target, model,
             CASE WHEN lag(y_true) OVER w IS NOT NULL
                  THEN CAST(((y_true - lag(y_true) OVER w) > 0) = ((y_pred - lag(y_pred) OVER w) > 0) AS INTEGER)
             END AS agree
      FROM predictions WINDOW w AS (PARTITION BY service, target, model ORDER BY idx)) s
    GROUP BY service, target, model""")
def directional_accuracy(spark, sf):
    """V-6: agreement of the direction of change."""
    return sc.directional_accuracy(ad.predictions(spark, sf), chunk_rows=100_000)


_CLF_COUNTS = """
    SELECT service, target, model,
           CAST(count_if(label = 1 AND proba > 0.5) AS BIGINT) AS tp, CAST(count_if(label = 0 AND proba > 0.5) AS BIGINT) AS fp,
           CAST(count_if(label = 0 AND NOT proba > 0.5) AS BIGINT) AS tn, CAST(count_if(label = 1 AND NOT proba > 0.5) AS BIGINT) AS fn
    FROM predictions GROUP BY service, target, model"""


@register("classification_metrics", adapters=["predictions"],
          floats=["accuracy", "precision", "recall", "f1", "threshold"], sql=f"""
    SELECT service, target, model, tp, fp, tn, fn,
           (tp + tn) / (tp + fp + tn + fn) AS accuracy,
           coalesce(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 0.0) AS precision,
           coalesce(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 0.0) AS recall,
           coalesce(CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2 * tp / (2 * tp + fp + fn) END, 0.0) AS f1,
           0.5::DOUBLE AS threshold
    FROM ({_CLF_COUNTS}) c""")
def classification_metrics(spark, sf):
    """V-7: confusion counts and classification metrics at 0.5."""
    return sc.classification_metrics(ad.predictions(spark, sf))


def _pr(t, fp, fn):
    p = f"coalesce(CASE WHEN {t} + {fp} = 0 THEN NULL ELSE {t} / ({t} + {fp}) END, 0.0)"
    r = f"coalesce(CASE WHEN {t} + {fn} = 0 THEN NULL ELSE {t} / ({t} + {fn}) END, 0.0)"
    f = f"coalesce(CASE WHEN 2 * {t} + {fp} + {fn} = 0 THEN NULL ELSE 2 * {t} / (2 * {t} + {fp} + {fn}) END, 0.0)"
    return p, r, f


_P1, _R1, _F1 = _pr("tp", "fp", "fn")
_P0, _R0, _F0 = _pr("tn", "fn", "fp")


@register("weighted_classification", adapters=["predictions"],
          floats=["weighted_precision", "weighted_recall", "weighted_f1"], sql=f"""
    SELECT service, target, model,
           ({_P1} * (tp + fn) + {_P0} * (tn + fp)) / (tp + fp + tn + fn) AS weighted_precision,
           ({_R1} * (tp + fn) + {_R0} * (tn + fp)) / (tp + fp + tn + fn) AS weighted_recall,
           ({_F1} * (tp + fn) + {_F0} * (tn + fp)) / (tp + fp + tn + fn) AS weighted_f1
    FROM ({_CLF_COUNTS}) c""")
def weighted_classification(spark, sf):
    """V-8: support-weighted precision / recall / F1."""
    return sc.weighted_classification(ad.predictions(spark, sf))


@register("roc_auc", adapters=["predictions"], floats=["roc_auc"], sql="""
    SELECT service, target, model,
           CASE WHEN p = 0 OR q = 0 THEN 0.0 ELSE (rank_sum - p * (p + 1) / 2.0) / (p * q) END AS roc_auc
    FROM (SELECT service, target, model, sum(label * r) AS rank_sum, sum(label) AS p,
                 count(*) - sum(label) AS q
          FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY service, target, model, proba) - 1) / 2.0 AS r
                FROM predictions WINDOW w AS (PARTITION BY service, target, model ORDER BY proba)) s
          GROUP BY service, target, model) a""")
def roc_auc(spark, sf):
    """V-9: ROC area by average ranks."""
    return sc.roc_auc(ad.predictions(spark, sf))


@register("grade", adapters=["predictions"], floats=["r2", "mape"], sql=f"""
    SELECT service, target, model, r2, mape, {_grade_sql('r2', 'mape')} AS grade,
           {_grade_sql('r2', 'mape', gr.LADDER_FIVE)} AS grade_five
    FROM ({_metrics_sql()}) m""")
def grade(spark, sf):
    """V-11: both grade ladders on (r2, mape)."""
    m = _metrics(spark, sf)
    return m.select("service", "target", "model", "r2", "mape",
                    gr.grade(F.col("r2"), F.col("mape")).alias("grade"),
                    gr.grade(F.col("r2"), F.col("mape"), gr.LADDER_FIVE).alias("grade_five"))


@register("rank_models", adapters=["predictions"], floats=["r2"], sql=f"""
    WITH m AS ({_metrics_sql()})
    SELECT service, target, model, r2,
           row_number() OVER (PARTITION BY service, target ORDER BY r2 DESC, model) AS rank,
           first_value(model) OVER (PARTITION BY service, target ORDER BY r2 DESC, model
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_model,
           last_value(model) OVER (PARTITION BY service, target ORDER BY r2 DESC, model
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS worst_model
    FROM m""")
def rank_models(spark, sf):
    """V-12: rank by r2 with best and worst model."""
    return gr.rank_models(_metrics(spark, sf))


@register("best_model", adapters=["predictions"], floats=["best_mse"], sql=f"""
    WITH m AS ({_metrics_sql()})
    SELECT service, target, arg_min(model, (mse, model)) AS best_model, min(mse) AS best_mse
    FROM m GROUP BY service, target""")
def best_model(spark, sf):
    """V-13: lowest-MSE model per (service, target)."""
    return gr.best_model(_metrics(spark, sf))


@register("pairwise_compare", adapters=["predictions"], floats=["model1_r2", "model2_r2", "difference"], sql=f"""
    WITH m AS ({_metrics_sql()})
    SELECT a.service, a.target, a.model AS model1, b.model AS model2, a.r2 AS model1_r2, b.r2 AS model2_r2,
           a.r2 - b.r2 AS difference, CASE WHEN a.r2 > b.r2 THEN a.model ELSE b.model END AS better_model
    FROM m a JOIN m b ON a.service = b.service AND a.target = b.target
    JOIN (VALUES ('forest', 'boosted'), ('forest', 'seasonal'), ('boosted', 'seasonal')) p(m1, m2)
      ON a.model = p.m1 AND b.model = p.m2""")
def pairwise_compare(spark, sf):
    """V-14: r2 difference and winner per model pair."""
    return gr.pairwise_compare(_metrics(spark, sf), ad.MODELS)


_VERDICT = ("CASE WHEN s.ready_ratio >= 0.8 THEN 'ready' WHEN s.ready_ratio >= 0.5 THEN 'conditionally_ready' "
            "ELSE 'not_ready' END")


@register("readiness", adapters=["predictions"], floats=["ready_ratio"], sql=f"""
    WITH g AS (SELECT service, target, model, {_grade_sql('r2', 'mape')} AS grade, r2, mape
               FROM ({_metrics_sql()}) m),
    p AS (SELECT service, target, model, grade,
                 (grade IN ('A+', 'A', 'B+') AND r2 > 0.7 AND mape < 0.2) AS hi,
                 (grade IN ('B', 'C+') AND r2 > 0.6 AND mape < 0.3) AS med FROM g),
    s AS (SELECT service, target, avg(CAST(hi OR med AS DOUBLE)) AS ready_ratio, count(*) AS n_models
          FROM p GROUP BY service, target)
    SELECT p.service, p.target, p.model, p.grade, hi OR med AS ready,
           CASE WHEN hi THEN 'high' WHEN med THEN 'medium' ELSE 'low' END AS confidence_level,
           s.ready_ratio, s.n_models,
           {_VERDICT} AS overall_readiness,
           CASE {_VERDICT} WHEN 'ready' THEN ['ready to deploy']
                WHEN 'conditionally_ready' THEN ['deploy with monitoring', 'add training data']
                ELSE ['improve models first', 'revise features', 'add training data'] END AS recommendations
    FROM p JOIN s ON p.service = s.service AND p.target = s.target""")
def readiness(spark, sf):
    """V-15: per-model readiness and per-key verdict."""
    return gr.readiness(_metrics(spark, sf))


@register("advice", adapters=["predictions"], sql=f"""
    WITH g AS (SELECT service, target, model, r2, mape, {_grade_sql('r2', 'mape')} AS grade
               FROM ({_metrics_sql()}) m)
    SELECT service, target, model, grade, array_to_string(list_filter([
             CASE WHEN r2 < 0.5 THEN 'Low R2: consider more features or another model' END,
             CASE WHEN mape > 0.3 THEN 'High MAPE: predictions deviate strongly' END,
             CASE WHEN grade IN ('A+', 'A') THEN 'Excellent accuracy: suitable for production' END,
             CASE WHEN grade IN ('C', 'D') THEN 'Poor grade: tune hyperparameters or retrain with more data' END],
             lambda x: x IS NOT NULL), '; ') AS advice
    FROM g""")
def advice(spark, sf):
    """V-16: advice texts per model."""
    return gr.advice(_metrics(spark, sf)).withColumn("advice", F.array_join("advice", "; "))


_STEPS = " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in gr.NEXT_STEPS.items())


@register("executive_summary", adapters=["predictions"], floats=["best_model_r2"], sql=f"""
    WITH g AS (SELECT service, target, model, r2, mape, {_grade_sql('r2', 'mape')} AS grade FROM ({_metrics_sql()}) m),
    s AS (SELECT service, target, count(*) AS n_models, arg_min(model, (-r2, model)) AS best_model, max(r2) AS best_r2,
                 arg_min(grade, (-r2, model)) AS best_grade,
                 avg(CAST(grade IN ('A+', 'A', 'B+') AND r2 > 0.7 AND mape < 0.2
                          OR grade IN ('B', 'C+') AND r2 > 0.6 AND mape < 0.3 AS DOUBLE)) AS ready_ratio
          FROM g GROUP BY service, target)
    SELECT service, target, n_models, best_model, best_r2 AS best_model_r2, best_grade AS best_model_grade,
           {_VERDICT} AS production_readiness,
           CASE WHEN best_r2 > 0.9 THEN 'excellent' WHEN best_r2 > 0.8 THEN 'good' ELSE 'needs_improvement' END
             AS overall_assessment,
           CASE {_VERDICT} {_STEPS} END AS next_steps
    FROM s""")
def executive_summary(spark, sf):
    """V-16: best model, readiness, assessment and next steps per key."""
    return gr.executive_summary(_metrics(spark, sf)).withColumn("next_steps", F.array_join("next_steps", "; "))


@register("cross_service", adapters=["predictions"],
          floats=["best_r2", "mean_r2", "std_r2", "min_r2", "max_r2"], sql=f"""
    WITH per AS (SELECT service, greatest(max(r2), 0.0) AS best_r2 FROM ({_metrics_sql()}) m GROUP BY service)
    SELECT service, best_r2, row_number() OVER (ORDER BY best_r2 DESC, service) AS rank,
           avg(best_r2) OVER () AS mean_r2, stddev_pop(best_r2) OVER () AS std_r2,
           min(best_r2) OVER () AS min_r2, max(best_r2) OVER () AS max_r2,
           arg_min(service, (-best_r2, service)) OVER () AS best_service,
           arg_min(service, (best_r2, service)) OVER () AS worst_service
    FROM per""")
def cross_service(spark, sf):
    """V-17: best r2 per service and fleet statistics."""
    return gr.cross_service(_metrics(spark, sf))


_COMP_SQL = """
    SELECT r.service, r.target, r.model, r.status,
           CASE WHEN r.status = 'success' THEN coalesce(mse <= mse_max, false) END AS mse_compliant,
           CASE WHEN r.status = 'success' THEN coalesce(mae <= mae_max, false) END AS mae_compliant,
           CASE WHEN r.status = 'success' THEN coalesce(r2 >= r2_min, false) END AS r2_compliant,
           CASE WHEN r.status = 'success' THEN coalesce(mse <= mse_max, false) AND coalesce(mae <= mae_max, false)
                                               AND coalesce(r2 >= r2_min, false) END AS overall_compliant,
           CASE WHEN r.status = 'success' THEN confidence >= confidence_min END AS confidence_compliant
    FROM model_results r JOIN (VALUES ('cpu_target', 0.01, 0.05, 0.3, 0.7),
                                      ('memory_target', 1e12, 1e8, -5.0, 0.5),
                                      ('replica_target', 0.5, 0.3, 0.4, 0.7))
         st(target, mse_max, mae_max, r2_min, confidence_min) ON r.target = st.target"""

_SCORE_SQL = f"""
    SELECT service, avg(CAST(passed AS DOUBLE)) * 100 AS overall_score, count(passed) AS n_checks
    FROM (SELECT service, unnest([mse_compliant, mae_compliant, r2_compliant, overall_compliant,
                                  confidence_compliant]) AS passed FROM ({_COMP_SQL}) c) u
    GROUP BY service"""


def _compliance(spark, sf):
    return gr.compliance(ad.model_results(spark, sf), keys=("service", "target", "model"))


@register("compliance", adapters=["model_results"], sql=_COMP_SQL)
def compliance(spark, sf):
    """V-18: standards checks per (service, target)."""
    return _compliance(spark, sf)


@register("overall_score", adapters=["model_results"], floats=["overall_score"], sql=f"""
    SELECT service, overall_score, n_checks,
           CASE WHEN overall_score >= 80 THEN 'excellent' WHEN overall_score >= 60 THEN 'good'
                WHEN overall_score >= 40 THEN 'acceptable' ELSE 'below_standard' END AS band
    FROM ({_SCORE_SQL}) s""")
def overall_score(spark, sf):
    """V-19 + V-20: compliance score and band per service."""
    s = gr.overall_score(_compliance(spark, sf))
    return s.withColumn("band", gr.score_band(F.col("overall_score")))


@register("evaluation_summary", adapters=["model_results"], floats=["average_score"], sql=f"""
    SELECT count(*) AS total_services, count(overall_score) AS successful_evaluations,
           count(*) - count(overall_score) AS failed_evaluations, avg(overall_score) AS average_score,
           CAST(count_if(overall_score >= 80) AS BIGINT) AS excellent_services,
           CAST(count_if(overall_score >= 60 AND overall_score < 80) AS BIGINT) AS good_services,
           CAST(count_if(overall_score >= 40 AND overall_score < 60) AS BIGINT) AS acceptable_services,
           CAST(count_if(overall_score < 40) AS BIGINT) AS below_standard_services,
           CAST(count_if(overall_score >= 60) AS BIGINT) AS good_or_better_services,
           CASE WHEN avg(overall_score) >= 90 THEN 'outstanding' WHEN avg(overall_score) >= 80 THEN 'excellent'
                WHEN avg(overall_score) >= 70 THEN 'good' WHEN avg(overall_score) >= 60 THEN 'acceptable'
                ELSE 'below_standards' END AS fleet_band
    FROM ({_SCORE_SQL}) s""")
def evaluation_summary(spark, sf):
    """V-21 (+ V-20 fleet ladder)."""
    s = gr.evaluation_summary(gr.overall_score(_compliance(spark, sf)))
    return s.withColumn("fleet_band", gr.fleet_band(F.col("average_score")))


@register("score_by_target", adapters=["model_results"], floats=["mean_score"], sql=f"""
    SELECT p.target, avg(s.overall_score) AS mean_score, count(*) AS n_services
    FROM (SELECT DISTINCT service, target FROM ({_COMP_SQL}) c WHERE status = 'success') p JOIN ({_SCORE_SQL}) s
      ON p.service = s.service GROUP BY p.target""")
def score_by_target(spark, sf):
    """V-22: mean score of the services having each target."""
    c = _compliance(spark, sf)
    return gr.score_by_target(c, gr.overall_score(c))


@register("results_table", adapters=["predictions"],
          floats=[f"{m}_{v}" for m in ad.MODELS for v in ("mse", "mae", "r2", "weight")], sql=f"""
    WITH m AS ({_metrics_sql()}),
    c AS (SELECT service, target, count(*) FILTER (WHERE idx % 5 <> 0) AS train_samples,
                 count(*) FILTER (WHERE idx % 5 = 0) AS test_samples
          FROM predictions WHERE model = '{ad.MODELS[0]}' GROUP BY service, target),
    w AS (SELECT service, target,
           {", ".join(f"max(CASE WHEN model = '{m}' THEN {v} END) AS {m}_{v}"
                      for m in ad.MODELS for v in ("mse", "mae", "r2"))},
           {", ".join(f"max(CASE WHEN model = '{m}' AND rmse > 0 THEN 1.0 / rmse END) / sum(CASE WHEN rmse > 0 THEN 1.0 / rmse END) "
                      f"AS {m}_weight" for m in ad.MODELS)},
           max(n) AS n_samples
    FROM m GROUP BY service, target)
    SELECT w.*, c.train_samples, c.test_samples FROM w JOIN c ON w.service = c.service AND w.target = c.target""")
def results_table(spark, sf):
    """V-23: one wide row per (service, target): every model's metrics, hybrid
    weights, sample counts of the (idx based) split."""
    p = ad.predictions(spark, sf).where(F.col("model") == ad.MODELS[0])
    split = p.groupBy("service", "target", F.when(F.col("idx") % 5 == 0, "test").otherwise("train").alias("split")).agg(
        F.count("*").alias("n"))
    return gr.results_table(_metrics(spark, sf), ad.MODELS, split=split)


_W_SQL = f"""
    WITH m AS ({_metrics_sql()}),
    w AS (SELECT service, target, model, raw / sum(raw) OVER (PARTITION BY service, target) AS weight,
                 count(*) OVER (PARTITION BY service, target) AS n_models
          FROM (SELECT service, target, model, RAWEXPR AS raw FROM m) r),
    e AS (SELECT p.service, p.target, p.idx, first(p.y_true) AS y_true, sum(w.weight * p.y_pred) AS y_pred,
                 'ENSNAME' AS model
          FROM predictions p JOIN w ON p.service = w.service AND p.target = w.target AND p.model = w.model
          WHERE w.n_models >= 2 GROUP BY p.service, p.target, p.idx)
    {_metrics_sql('e')}"""


@register("inverse_error_vote", adapters=["predictions"], floats=_REG_FLOATS,
          sql=_W_SQL.replace("RAWEXPR", "1.0 / (mse + 1e-8)").replace("ENSNAME", "weighted_voting"))
def inverse_error_vote(spark, sf):
    """M-6: inverse-MSE weighted voting ensemble, scored."""
    return en.inverse_error_vote(ad.predictions(spark, sf))


@register("hybrid_rmse", adapters=["predictions"], floats=_REG_FLOATS,
          sql=_W_SQL.replace("RAWEXPR", "CASE WHEN rmse = 0 THEN NULL ELSE 1.0 / rmse END")
          .replace("ENSNAME", "hybrid"))
def hybrid_rmse(spark, sf):
    """M-7: inverse-RMSE weighted hybrid, scored."""
    return en.hybrid_rmse(ad.predictions(spark, sf))


@register("fuse", adapters=["predictions"],
          floats=["prediction", "confidence", "forecast_prediction", "sequence_prediction"], sql="""
    WITH k AS (SELECT DISTINCT service, target FROM predictions),
    f AS (SELECT service, target, arg_max(y_pred, idx) AS fp FROM predictions
          WHERE model = 'seasonal' AND NOT (service = 'svc-0' AND target = 'replica_target')
          GROUP BY service, target),
    s AS (SELECT service, target, arg_max(y_pred, idx) AS sp,
                 avg((y_pred - y_true) * (y_pred - y_true)) / 1e6 AS mse FROM predictions
          WHERE model = 'forest' AND NOT (service = 'svc-1' AND target = 'cpu_target')
            AND NOT (service = 'svc-0' AND target = 'replica_target')
          GROUP BY service, target)
    SELECT k.service, k.target,
           CASE WHEN fp IS NOT NULL AND sp IS NOT NULL THEN 0.4 * fp + 0.6 * sp
                WHEN fp IS NOT NULL THEN fp WHEN sp IS NOT NULL THEN sp ELSE 0.0 END AS prediction,
           CASE WHEN fp IS NOT NULL AND sp IS NOT NULL THEN
                  (CASE WHEN coalesce(mse, 0.0) > 0 THEN least(0.9, greatest(0.5, 1.0 - coalesce(mse, 0.0) / 1000.0))
                        ELSE 0.7 END)
                WHEN fp IS NOT NULL THEN 0.6 WHEN sp IS NOT NULL THEN 0.5 ELSE 0.3 END AS confidence,
           fp AS forecast_prediction, sp AS sequence_prediction, 'success' AS status
    FROM k LEFT JOIN f ON k.service = f.service AND k.target = f.target
           LEFT JOIN s ON k.service = s.service AND k.target = s.target""")
def fuse(spark, sf):
    """M-9 + M-10: forecast / sequence fusion with confidence.  The 'seasonal'
    model plays the forecast and 'forest' the sequence model; a few keys lack
    one or both so that every branch is exercised."""
    p = ad.predictions(spark, sf)
    keys = p.select("service", "target")
    no_f = (F.col("service") == "svc-0") & (F.col("target") == "replica_target")
    no_s = ((F.col("service") == "svc-1") & (F.col("target") == "cpu_target")) | no_f
    fc = p.where((F.col("model") == "seasonal") & ~no_f).select(
        "service", "target", F.col("idx").alias("ds"), F.col("y_pred").alias("yhat"))
    sq = p.where((F.col("model") == "forest") & ~no_s)
    sm = sq.groupBy("service", "target").agg(
        (F.avg((F.col("y_pred") - F.col("y_true")) ** 2) / 1e6).alias("mse"))
    return en.fuse(keys, fc, sq.select("service", "target", "idx", "y_pred"), sm)
