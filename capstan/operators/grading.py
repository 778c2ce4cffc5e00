"""Grading, ranking, readiness and standards compliance (V-11..V-23).

These run on metric tables (one row per service/target/model), which are tiny
next to the predictions they summarise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .windows import dense_position

# Grade ladders as (grade, r2 must exceed, mape must stay below).
LADDER_SEVEN = [("A+", 0.95, 0.05), ("A", 0.90, 0.10), ("B+", 0.80, 0.15), ("B", 0.70, 0.20),
                ("C+", 0.60, 0.30), ("C", 0.50, 0.40)]
LADDER_FIVE = [("A+", 0.9, 0.1), ("A", 0.8, 0.2), ("B", 0.7, 0.3), ("C", 0.6, 0.4)]

# Prediction standards per target (mse max, mae max, r2 min, confidence min).
STANDARDS = [("cpu_target", 0.01, 0.05, 0.3, 0.7),
             ("memory_target", 1e12, 1e8, -5.0, 0.5),
             ("replica_target", 0.5, 0.3, 0.4, 0.7)]

# Next steps by readiness verdict.
NEXT_STEPS = {
    "ready": ["deploy the best model", "set up monitoring", "schedule retraining"],
    "conditionally_ready": ["deploy with close monitoring", "collect training data", "plan improvements"],
    "not_ready": ["improve models before deployment", "collect varied training data", "try other algorithms"],
}

# Score bands.
BANDS = [(80.0, "excellent"), (60.0, "good"), (40.0, "acceptable")]
FLEET_BANDS = [(90.0, "outstanding"), (80.0, "excellent"), (70.0, "good"), (60.0, "acceptable")]


def grade(r2: Column, mape: Column, ladder=LADDER_SEVEN) -> Column:
    """V-11: first ladder step whose r2 and mape limits hold, else ``D``."""
    out = None
    for g, r_min, m_max in ladder:
        cond = (r2 > r_min) & (mape < m_max)
        out = F.when(cond, g) if out is None else out.when(cond, g)
    return out.otherwise("D")


def rank_models(metrics: DataFrame, keys=("service", "target")) -> DataFrame:
    """V-12: models ranked by r2 descending within each key; best and worst."""
    w = Window.partitionBy(*keys).orderBy(F.col("r2").desc(), F.col("model"))
    ranked = metrics.select(*keys, "model", "r2", F.row_number().over(w).alias("rank"))
    best = metrics.groupBy(*keys).agg(
        F.min_by("model", F.struct(-F.col("r2"), F.col("model"))).alias("best_model"),
        F.max_by("model", F.struct(-F.col("r2"), F.col("model"))).alias("worst_model"))
    return ranked.join(best, list(keys))


def best_model(metrics: DataFrame, keys=("service", "target"), by: str = "mse") -> DataFrame:
    """V-13: lowest-``by`` model per key (ties: model name)."""
    return metrics.groupBy(*keys).agg(
        F.min_by("model", F.struct(F.col(by), F.col("model"))).alias("best_model"),
        F.min(by).alias(f"best_{by}"))


def pairwise_compare(metrics: DataFrame, models, keys=("service", "target")) -> DataFrame:
    """V-14: r2 difference and winner for each pair of the given model list.

    The pairs come from the (fixed, small) model list, so the result has
    |pairs| rows per key; it never pairs data rows.
    """
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    spark = metrics.sparkSession
    pair_df = spark.createDataFrame(pairs, "model1 string, model2 string")
    m1 = metrics.select(*keys, F.col("model").alias("model1"), F.col("r2").alias("model1_r2"))
    m2 = metrics.select(*keys, F.col("model").alias("model2"), F.col("r2").alias("model2_r2"))
    # the pair list is built from the model list argument: |models|^2 / 2 rows
    j = m1.join(F.broadcast(pair_df), "model1").join(m2, [*keys, "model2"])
    return j.select(
        *keys, "model1", "model2", "model1_r2", "model2_r2",
        (F.col("model1_r2") - F.col("model2_r2")).alias("difference"),
        F.when(F.col("model1_r2") > F.col("model2_r2"), F.col("model1")).otherwise(F.col("model2")).alias("better_model"))


def readiness(metrics: DataFrame, keys=("service", "target")) -> DataFrame:
    """V-15: per model readiness / confidence; per key the ready share and the
    overall verdict with its advice texts."""
    g = grade(F.col("r2"), F.col("mape"))
    high = g.isin("A+", "A", "B+") & (F.col("r2") > 0.7) & (F.col("mape") < 0.2)
    med = g.isin("B", "C+") & (F.col("r2") > 0.6) & (F.col("mape") < 0.3)
    per = metrics.select(*keys, "model", g.alias("grade"), (high | med).alias("ready"),
                         F.when(high, "high").when(med, "medium").otherwise("low").alias("confidence_level"))
    ratio = F.avg(F.col("ready").cast("double"))
    verdict = (F.when(F.col("ready_ratio") >= 0.8, "ready")
               .when(F.col("ready_ratio") >= 0.5, "conditionally_ready").otherwise("not_ready"))
    summary = per.groupBy(*keys).agg(ratio.alias("ready_ratio"), F.count("*").alias("n_models"))
    advice = (F.when(verdict == "ready", F.array(F.lit("ready to deploy")))
              .when(verdict == "conditionally_ready", F.array(F.lit("deploy with monitoring"), F.lit("add training data")))
              .otherwise(F.array(F.lit("improve models first"), F.lit("revise features"), F.lit("add training data"))))
    summary = summary.select(*keys, "ready_ratio", "n_models", verdict.alias("overall_readiness"),
                             advice.alias("recommendations"))
    return per.join(summary, list(keys))


def advice(metrics: DataFrame, keys=("service", "target")) -> DataFrame:
    """V-16: advice texts from r2, mape and grade per model."""
    g = grade(F.col("r2"), F.col("mape"))
    texts = F.array_compact(F.array(
        F.when(F.col("r2") < 0.5, F.lit("Low R2: consider more features or another model")),
        F.when(F.col("mape") > 0.3, F.lit("High MAPE: predictions deviate strongly")),
        F.when(g.isin("A+", "A"), F.lit("Excellent accuracy: suitable for production")),
        F.when(g.isin("C", "D"), F.lit("Poor grade: tune hyperparameters or retrain with more data"))))
    return metrics.select(*keys, "model", g.alias("grade"), texts.alias("advice"))


def executive_summary(metrics: DataFrame, keys=("service", "target")) -> DataFrame:
    """V-16: per key the number of models, the best one with its r2 and grade, the
    readiness verdict, an overall assessment and the next steps."""
    keys = list(keys)
    best = F.min_by(F.struct("model", "r2", "mape"), F.struct(-F.col("r2"), F.col("model")))
    top = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), best.alias("_b"))
    verdict = readiness(metrics, keys).select(*keys, "overall_readiness").distinct()
    r2 = F.col("_b.r2")
    steps = (F.when(F.col("overall_readiness") == "ready", F.array(*map(F.lit, NEXT_STEPS["ready"])))
             .when(F.col("overall_readiness") == "conditionally_ready", F.array(*map(F.lit, NEXT_STEPS["conditionally_ready"])))
             .otherwise(F.array(*map(F.lit, NEXT_STEPS["not_ready"]))))
    return top.join(verdict, keys).select(
        *keys, "n_models", F.col("_b.model").alias("best_model"), r2.alias("best_model_r2"),
        grade(r2, F.col("_b.mape")).alias("best_model_grade"), F.col("overall_readiness").alias("production_readiness"),
        F.when(r2 > 0.9, "excellent").when(r2 > 0.8, "good").otherwise("needs_improvement").alias("overall_assessment"),
        steps.alias("next_steps"))


def cross_service(metrics: DataFrame) -> DataFrame:
    """V-17: best r2 per service (floored at 0), ranking and fleet statistics.

    Everything after the first aggregate runs over the per-service table
    (one row per service), never over data rows.
    """
    per = scratch_table(metrics.groupBy("service").agg(F.greatest(F.max("r2"), F.lit(0.0)).alias("best_r2")), "services")
    r = F.col("best_r2")
    fleet = per.agg(F.avg(r).alias("mean_r2"), F.stddev_pop(r).alias("std_r2"), F.min(r).alias("min_r2"), F.max(r).alias("max_r2"),
                    F.min_by("service", F.struct(-r, F.col("service"))).alias("best_service"),
                    F.min_by("service", F.struct(r, F.col("service"))).alias("worst_service"))
    ranked = dense_position(per.withColumn("_neg", -r), [], ["_neg", "service"], "_pos")
    return ranked.crossJoin(F.broadcast(fleet)).select(  # one row
        "service", "best_r2", (F.col("_pos") + 1).cast("int").alias("rank"), "mean_r2", "std_r2", "min_r2", "max_r2",
        "best_service", "worst_service")


def standards_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STANDARDS, "target string, mse_max double, mae_max double, "
                                            "r2_min double, confidence_min double")


def compliance(model_results: DataFrame, standards: DataFrame | None = None, keys=("service", "target")) -> DataFrame:
    """V-18: checks against the standards table, one row per result.

    A NULL metric fails its check.  A result that is no success keeps its row
    with NULL checks, so that later counts see it.  Targets without a standard are
    dropped."""
    st = standards if standards is not None else standards_table(model_results.sparkSession)
    j = model_results.join(st.withColumnRenamed("target", "_st"), F.col("target") == F.col("_st")).drop("_st")
    ok = F.col("status") == "success"
    mse_ok = F.coalesce(F.col("mse") <= F.col("mse_max"), F.lit(False))
    mae_ok = F.coalesce(F.col("mae") <= F.col("mae_max"), F.lit(False))
    r2_ok = F.coalesce(F.col("r2") >= F.col("r2_min"), F.lit(False))
    conf_ok = F.when(F.col("confidence").isNotNull(), F.col("confidence") >= F.col("confidence_min"))
    return j.select(
        *keys, "status", F.when(ok, mse_ok).alias("mse_compliant"), F.when(ok, mae_ok).alias("mae_compliant"),
        F.when(ok, r2_ok).alias("r2_compliant"), F.when(ok, mse_ok & mae_ok & r2_ok).alias("overall_compliant"),
        F.when(ok, conf_ok).alias("confidence_compliant"))


CHECKS = ("mse_compliant", "mae_compliant", "r2_compliant", "overall_compliant", "confidence_compliant")


def overall_score(comp: DataFrame) -> DataFrame:
    """V-19: passed / counted checks x 100 per service (missing confidence is not
    counted); NULL for a service without a successful result."""
    passed = sum(F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in CHECKS)
    counted = sum(F.col(c).isNotNull().cast("int") for c in CHECKS)
    return comp.groupBy("service").agg(F.sum(passed).alias("_p"), F.sum(counted).alias("n_checks")).select(
        "service", (F.try_divide(F.col("_p"), F.col("n_checks")) * 100).alias("overall_score"), "n_checks")


def score_band(score: Column) -> Column:
    """V-20 service band."""
    out = None
    for lim, name in BANDS:
        out = F.when(score >= lim, name) if out is None else out.when(score >= lim, name)
    return out.otherwise("below_standard")


def fleet_band(score: Column) -> Column:
    """V-20 fleet ladder."""
    out = None
    for lim, name in FLEET_BANDS:
        out = F.when(score >= lim, name) if out is None else out.when(score >= lim, name)
    return out.otherwise("below_standards")


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """V-21: totals, mean score and count per band (bands do not overlap)."""
    s = F.col("overall_score")
    return scores.agg(
        F.count("*").alias("total_services"),
        F.count(s).alias("successful_evaluations"),
        (F.count("*") - F.count(s)).alias("failed_evaluations"),
        F.avg(s).alias("average_score"),
        F.count_if(s >= 80).alias("excellent_services"),
        F.count_if((s >= 60) & (s < 80)).alias("good_services"),
        F.count_if((s >= 40) & (s < 60)).alias("acceptable_services"),
        F.count_if(s < 40).alias("below_standard_services"),
        F.count_if(s >= 60).alias("good_or_better_services"))


def score_by_target(comp: DataFrame, scores: DataFrame) -> DataFrame:
    """V-22: mean overall score of the services with a successful result for
    each target."""
    pairs = comp.where(F.col("status") == "success").select("service", "target").distinct()
    return (pairs.join(scores, "service")
            .groupBy("target").agg(F.avg("overall_score").alias("mean_score"),
                                   F.count("*").alias("n_services")))


def results_table(metrics: DataFrame, models, keys=("service", "target"), values=("mse", "mae", "r2"),
                  split: DataFrame | None = None) -> DataFrame:
    """V-23: one wide row per key with every model's metrics, the models' weights
    in the inverse-RMSE hybrid (NULL where a model's rmse is 0) and the sample
    counts; ``split`` (keys, split, n) adds train and test counts."""
    keys = list(keys)
    raw = F.when(F.col("rmse") > 0, 1.0 / F.col("rmse"))
    cells = [F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}") for m in models for v in values]
    weights = [F.max(F.when(F.col("model") == m, raw)).alias(f"_{m}") for m in models]
    wide = metrics.groupBy(*keys).agg(*cells, *weights, F.sum(raw).alias("_all"), F.max("n").alias("n_samples"))
    out = wide.select(*keys, *[f"{m}_{v}" for m in models for v in values],
                      *[(F.col(f"_{m}") / F.col("_all")).alias(f"{m}_weight") for m in models], "n_samples")
    if split is not None:
        counts = split.groupBy(*keys).agg(*[F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)).alias(f"{x}_samples")
                                            for x in ("train", "test")])
        out = out.join(counts, keys, "left")
    return out
