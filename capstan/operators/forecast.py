"""Seasonal forecaster (M-4): piecewise-linear trend + daily / weekly Fourier
seasonality + optional regressors, fitted per group by ridge least squares.

The fit is Spark-native: the design row of every sample is a Column array;
ONE aggregate per group sums the outer products ``x_i x_j`` and ``x_i y``
(partial aggregation, so a hot group is reduced map-side); only the k x k
solves run in Python, batched with numpy over the one-row-per-group table
(``mapInPandas``, no extra shuffle).  The aggregate has k(k+1)/2 buffer
fields; sessions should allow whole-stage codegen that wide
(``spark.sql.codegen.maxFields``, set by :func:`capstan.session.get_session`).
Predictions are JVM-side dot products with the broadcast coefficient table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import maybe_broadcast, scratch_table
from .windows import join_null_safe

# Seasonal periods in hours, Fourier orders, changepoints, interval.
DAY_H, WEEK_H = 24.0, 168.0
DAILY_ORDER, WEEKLY_ORDER = 3, 3
N_CHANGEPOINTS = 5
CHANGEPOINT_RANGE = 0.8
Z_90 = 1.6448536269514722
RIDGE = 1e-6


def _design(t: Column, lo: Column, span: Column, regressors) -> list[Column]:
    """Design columns: intercept, scaled trend, hinges, Fourier pairs, regressors."""
    ts = F.when(span > 0, (t - lo) / span).otherwise(F.lit(0.0))
    cols = [F.lit(1.0), ts]
    for j in range(N_CHANGEPOINTS):
        c = CHANGEPOINT_RANGE * (j + 1) / (N_CHANGEPOINTS + 1)
        cols.append(F.greatest(ts - c, F.lit(0.0)))
    for period, order in ((DAY_H, DAILY_ORDER), (WEEK_H, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            ang = 2 * math.pi * k * t / period
            cols += [F.sin(ang), F.cos(ang)]
    cols += [F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in regressors]
    return cols


def _dot(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def fit_seasonal(df: DataFrame, keys, t: str, y: str, regressors=(), ridge: float = RIDGE) -> DataFrame:
    """Coefficients per group: (keys, lo, span, beta array, sigma, n)."""
    keys = list(keys)
    rng = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    d = join_null_safe(df.where(F.col(y).isNotNull()), maybe_broadcast(rng), keys)
    span = F.col("_hi") - F.col("_lo")
    x = _design(F.col(t).cast("double"), F.col("_lo"), span, regressors)
    k = len(x)
    d = d.select(*keys, "_lo", "_hi", F.array(*x).alias("_x"), F.col(y).cast("double").alias("_y"))
    sums = []
    for i in range(k):
        for j in range(i, k):
            sums.append(F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"a_{i}_{j}"))
    sums += [F.sum(F.col("_x")[i] * F.col("_y")).alias(f"b_{i}") for i in range(k)]
    sums += [F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count("*").alias("n"),
             F.first("_lo").alias("lo"), F.first("_hi").alias("hi")]
    normal = d.groupBy(*keys).agg(*sums)

    key_fields = [f for f in normal.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
        T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType()),
        T.StructField("n", T.LongType())])

    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(batches):
        # one row per group: assemble all k x k systems of the batch and
        # solve them together (batched numpy), no per-row Python loop
        for pdf in batches:
            if pdf.empty:
                continue
            g = len(pdf)
            a = np.zeros((g, k, k))
            for i, j in upper:
                a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"].to_numpy(dtype=float)
            b = np.stack([pdf[f"b_{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)
            reg = ridge * np.maximum(1.0, np.trace(a, axis1=1, axis2=2) / k)
            beta = np.linalg.solve(a + reg[:, None, None] * np.eye(k)[None], b[:, :, None])[:, :, 0]
            sse = (pdf["yy"].to_numpy(dtype=float) - 2 * np.einsum("gi,gi->g", beta, b)
                   + np.einsum("gi,gij,gj->g", beta, a, beta))
            dof = np.maximum(pdf["n"].to_numpy() - k, 1)
            out = pdf[keys].copy()
            out["lo"] = pdf["lo"].astype(float)
            out["hi"] = pdf["hi"].astype(float)
            out["beta"] = list(beta)
            out["sigma"] = np.sqrt(np.maximum(sse, 0.0) / dof)
            out["n"] = pdf["n"].astype("int64")
            yield out

    return normal.mapInPandas(solve, out_schema)


def seasonal_forecast(df: DataFrame, keys, t: str, y: str, horizon: int = 30, step: float = 0.25,
                      regressors=(), interval_z: float = Z_90) -> DataFrame:
    """M-4: fitted values for every input row plus ``horizon`` future steps of
    ``step`` hours after each group's last time; ``yhat`` with lower / upper
    bounds ``yhat -+ z sigma`` (z for a 90 % interval).  Future rows use 0
    for the regressors."""
    keys = list(keys)
    # the coefficient table (one row per group) is used twice: materialise it
    # once in the shared checkpoint folder
    coef = scratch_table(fit_seasonal(df, keys, t, y, regressors), "coefficients")
    hist = df.select(*keys, F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"),
                     *[F.col(r) for r in regressors], F.lit(False).alias("future"))
    fut = coef.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_i"), "hi").select(
        *keys, (F.col("hi") + F.col("_i") * step).alias("t"), F.lit(None).cast("double").alias("y"),
        *[F.lit(0.0).alias(r) for r in regressors], F.lit(True).alias("future"))
    allr = join_null_safe(hist.unionByName(fut), maybe_broadcast(coef), keys)
    span = F.col("hi") - F.col("lo")
    x = F.array(*_design(F.col("t"), F.col("lo"), span, regressors))
    yhat = _dot(x, F.col("beta"))
    return allr.select(*keys, "t", "y", "future", yhat.alias("yhat"),
                       (yhat - interval_z * F.col("sigma")).alias("yhat_lower"),
                       (yhat + interval_z * F.col("sigma")).alias("yhat_upper"))
