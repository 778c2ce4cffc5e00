"""Model scoring (V-1..V-9): one ``groupBy(service, target, model)`` computes
every metric of a group in a single pass with partial aggregation.

Input: ``predictions(service, target, model, idx, y_true, y_pred[, label, proba])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import CHUNK_ROWS, by_chunks, dense_position, join_null_safe, prefix_counts

EPS = 2.220446049250313e-16  # machine epsilon of float64 (mape floor)
GROUP = ("service", "target", "model")


def _r2(sse, var_n, n=None):
    # 1 - SSE/SST; constant truth: 1 when perfect, else 0 (finite form).
    return F.when(var_n == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / var_n)


def regression_metrics(pred: DataFrame, keys=GROUP, y="y_true", p="y_pred", median_mode: str = "exact") -> DataFrame:
    """V-1..V-5 in one aggregate: mse, rmse, mae, mape, r2, explained variance,
    max error, median absolute error, smape, log error, wmape.

    The median absolute error is exact with bounded memory per group
    (:mod:`capstan.operators.quantiles`) and joined to the aggregate;
    ``median_mode='approx'`` uses ``percentile_approx`` inside it, and None leaves
    the column out."""
    yt, yp = F.col(y), F.col(p)
    e = yp - yt
    ae = F.abs(e)
    if median_mode not in (None, "approx"):
        from .quantiles import exact_quantile
        base = regression_metrics(pred, keys, y, p, median_mode=None)
        med = exact_quantile(pred.select(*keys, ae.alias("_ae")), list(keys), "_ae", 0.5, "median_absolute_error")
        cols = base.columns
        at = cols.index("max_error") + 1
        return join_null_safe(base, med, list(keys), "left").select(*cols[:at], "median_absolute_error", *cols[at:])
    median = [F.percentile_approx(ae, 0.5, 10000).alias("median_absolute_error")] if median_mode == "approx" else []
    agg = pred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(ae).alias("mae"),
        F.avg(ae / F.greatest(F.abs(yt), F.lit(EPS))).alias("mape"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(yt) * F.count("*")).alias("_sst"),
        F.var_pop(yt).alias("_vy"),
        F.var_pop(e).alias("_ve"),
        F.max(ae).alias("max_error"),
        *median,
        (F.avg(F.try_divide(2 * ae, F.abs(yt) + F.abs(yp))) * 100).alias("smape"),
        (F.avg(F.abs(F.log1p(yt) - F.log1p(yp))) * 100).alias("mape_log"),
        (F.try_divide(F.sum(ae), F.sum(F.abs(yt))) * 100).alias("wmape"))
    return agg.select(
        *keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", "mape",
        _r2(F.col("_sse"), F.col("_sst")).alias("r2"),
        F.when(F.col("_vy") == 0, F.when(F.col("_ve") == 0, 1.0).otherwise(0.0))
         .otherwise(1 - F.col("_ve") / F.col("_vy")).alias("explained_variance"),
        "max_error", *(["median_absolute_error"] if median else []), "smape", "mape_log", "wmape")


def directional_accuracy(pred: DataFrame, keys=GROUP, order="idx", y="y_true", p="y_pred",
                         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """V-6: share of steps where the truth and the prediction move the same
    way (``diff > 0``); 0 when a group has fewer than two rows.  Groups run per
    position chunk with a one-row halo."""
    def run(d, parts):
        w = Window.partitionBy(*parts).orderBy(order)
        up_t = (F.col(y) - F.lag(y).over(w)) > 0
        up_p = (F.col(p) - F.lag(p).over(w)) > 0
        agree = F.when(F.lag(y).over(w).isNotNull(), (up_t == up_p).cast("int"))
        return d.select("*", agree.alias("agree"))
    d = dense_position(pred, keys, [order], "_dpos", chunk_rows)
    steps = by_chunks(d, keys, "_dpos", 1, run, chunk_rows)
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("agree"), F.lit(0.0)).alias("directional_accuracy"))


def classification_metrics(pred: DataFrame, keys=GROUP, label="label", proba="proba",
                           threshold: float = 0.5) -> DataFrame:
    """V-7: accuracy, precision, recall, F1 (0 when undefined) and the
    confusion matrix at ``proba > threshold``."""
    yhat = (F.col(proba) > threshold).cast("int")
    yl = F.col(label)
    agg = pred.groupBy(*keys).agg(
        F.count_if((yl == 1) & (yhat == 1)).alias("tp"),
        F.count_if((yl == 0) & (yhat == 1)).alias("fp"),
        F.count_if((yl == 0) & (yhat == 0)).alias("tn"),
        F.count_if((yl == 1) & (yhat == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return agg.select(
        *keys, "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.lit(threshold).alias("threshold"))


def weighted_classification(pred: DataFrame, keys=GROUP, label="label", proba="proba",
                            threshold: float = 0.5) -> DataFrame:
    """V-8: support-weighted precision / recall / F1 over the classes 0 and 1."""
    base = classification_metrics(pred, keys, label, proba, threshold)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def pr(t, f_p, f_n):
        p_ = F.coalesce(F.try_divide(t, t + f_p), F.lit(0.0))
        r_ = F.coalesce(F.try_divide(t, t + f_n), F.lit(0.0))
        f_ = F.coalesce(F.try_divide(2 * t, 2 * t + f_p + f_n), F.lit(0.0))
        return p_, r_, f_

    p1, r1, f1 = pr(tp, fp, fn)       # class 1, support tp+fn
    p0, r0, f0 = pr(tn, fn, fp)       # class 0, support tn+fp
    s1, s0 = tp + fn, tn + fp
    return base.select(
        *keys,
        F.try_divide(p1 * s1 + p0 * s0, n).alias("weighted_precision"),
        F.try_divide(r1 * s1 + r0 * s0, n).alias("weighted_recall"),
        F.try_divide(f1 * s1 + f0 * s0, n).alias("weighted_f1"))


def roc_auc(pred: DataFrame, keys=GROUP, label="label", proba="proba") -> DataFrame:
    """V-9: rank form of the ROC area with average ranks for ties; 0 when a
    group has one class only.

    Rows are first reduced to one row per (group, score) with positive and
    total counts (partial aggregation); the count of lower scores is a prefix sum
    in parts of bounded size.
    """
    per_score = pred.groupBy(*keys, proba).agg(
        F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = prefix_counts(per_score, keys, proba, "c")
    avg_rank = F.col("_below") + (F.col("c") + 1) / 2.0
    agg = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * avg_rank).alias("rank_sum"),
        F.sum("pos").alias("p"), (F.sum("c") - F.sum("pos")).alias("q"))
    p, q = F.col("p"), F.col("q")
    auc = (F.col("rank_sum") - p * (p + 1) / 2.0) / (p * q)
    return agg.select(*keys, F.when((p == 0) | (q == 0), 0.0).otherwise(auc).alias("roc_auc"))
