"""Ensembles over prediction tables (M-6, M-7, M-9, M-10).

Weights are computed on the per-model metrics table (tiny, broadcast) and
applied to predictions with one shuffle on (key, idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .scoring import regression_metrics

KEYS = ("service", "target")
# Fusion weights and confidences.
FORECAST_WEIGHT, SEQUENCE_WEIGHT = 0.4, 0.6
BASE_CONFIDENCE = 0.7
ONLY_FORECAST_CONF, ONLY_SEQUENCE_CONF, NO_MODEL_CONF = 0.6, 0.5, 0.3


def _weights(metrics: DataFrame, raw: Column, keys=KEYS, min_models: int = 2) -> DataFrame:
    per_key = Window.partitionBy(*keys)
    w = metrics.select(*keys, "model", raw.alias("raw"))
    w = w.select(*keys, "model", (F.col("raw") / F.sum("raw").over(per_key)).alias("weight"),
                 F.count("*").over(per_key).alias("n_models"))
    return w.where(F.col("n_models") >= min_models).drop("n_models")


def inverse_mse_weights(metrics: DataFrame, keys=KEYS) -> DataFrame:
    """M-6 weights: 1/(mse + 1e-8), normalised per key; needs >= 2 models."""
    return _weights(metrics, 1.0 / (F.col("mse") + 1e-8), keys)


def inverse_rmse_weights(metrics: DataFrame, keys=KEYS) -> DataFrame:
    """M-7 weights: 1/rmse normalised per key (NULL when a model is exact)."""
    return _weights(metrics, F.try_divide(F.lit(1.0), F.col("rmse")), keys)


def weighted_vote(pred: DataFrame, weights: DataFrame, keys=KEYS, order: str = "idx") -> DataFrame:
    """Weighted mean prediction per (key, idx); models without a weight drop."""
    j = pred.join(maybe_broadcast(weights), [*keys, "model"])
    return j.groupBy(*keys, order).agg(
        F.first("y_true").alias("y_true"),
        F.sum(F.col("weight") * F.col("y_pred")).alias("y_pred"))


def inverse_error_vote(pred: DataFrame, keys=KEYS) -> DataFrame:
    """M-6: metrics of the inverse-MSE weighted ensemble per key."""
    metrics = regression_metrics(pred, (*keys, "model"), median_mode=None)
    ens = weighted_vote(pred, inverse_mse_weights(metrics, keys), keys)
    return regression_metrics(ens.withColumn("model", F.lit("weighted_voting")), (*keys, "model"))


def hybrid_rmse(pred: DataFrame, keys=KEYS) -> DataFrame:
    """M-7: metrics of the inverse-RMSE weighted hybrid per key."""
    metrics = regression_metrics(pred, (*keys, "model"), median_mode=None)
    ens = weighted_vote(pred, inverse_rmse_weights(metrics, keys), keys)
    return regression_metrics(ens.withColumn("model", F.lit("hybrid")), (*keys, "model"))


def confidence(mse: Column, base: float = BASE_CONFIDENCE) -> Column:
    """M-10: base confidence, or clip(1 - mse/1000, 0.5, 0.9) when mse > 0."""
    return (F.when(mse > 0, F.least(F.lit(0.9), F.greatest(F.lit(0.5), 1.0 - mse / 1000.0)))
            .otherwise(F.lit(base)))


def fuse(keys_df: DataFrame, forecast: DataFrame, sequence: DataFrame,
         sequence_metrics: DataFrame, keys=KEYS) -> DataFrame:
    """M-9: last forecast value x 0.4 + last sequence prediction x 0.6.

    Only one model -> that value (confidence 0.6 forecast / 0.5 sequence);
    none -> 0.0 (0.3).  ``forecast(key, ds, yhat)``, ``sequence(key, idx, y_pred)``.
    """
    f_last = forecast.groupBy(*keys).agg(F.max_by("yhat", "ds").alias("forecast_prediction"))
    s_last = sequence.groupBy(*keys).agg(F.max_by("y_pred", "idx").alias("sequence_prediction"))
    j = (keys_df.select(*keys).distinct()
         .join(f_last, list(keys), "left").join(s_last, list(keys), "left")
         .join(maybe_broadcast(sequence_metrics.select(*keys, F.col("mse").alias("sequence_mse"))),
               list(keys), "left"))
    f, s = F.col("forecast_prediction"), F.col("sequence_prediction")
    both = f.isNotNull() & s.isNotNull()
    pred = (F.when(both, FORECAST_WEIGHT * f + SEQUENCE_WEIGHT * s)
            .when(f.isNotNull(), f).when(s.isNotNull(), s).otherwise(F.lit(0.0)))
    conf = (F.when(both, confidence(F.coalesce(F.col("sequence_mse"), F.lit(0.0))))
            .when(f.isNotNull(), F.lit(ONLY_FORECAST_CONF))
            .when(s.isNotNull(), F.lit(ONLY_SEQUENCE_CONF)).otherwise(F.lit(NO_MODEL_CONF)))
    return j.select(*keys, pred.alias("prediction"), conf.alias("confidence"),
                    "forecast_prediction", "sequence_prediction", F.lit("success").alias("status"))
