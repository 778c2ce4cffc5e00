"""Feature scaling (F-19, F-20).  Parameters are a small per-group table
(one aggregate) joined back; ``fit_on='train'`` fits on train rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast, scratch_table
from .derive import KEYS
from .quantiles import quantile_table
from .windows import join_null_safe


def _fit_rows(df: DataFrame, fit_on: str, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == "train") if fit_on == "train" else df


def scale(df: DataFrame, cols, method: str = "robust", fit_on: str = "train", keys=KEYS,
          split: str = "split") -> DataFrame:
    """F-19: robust (x - median) / (q75 - q25); standard (x - mean) / pop std;
    minmax (x - min) / (max - min).  A zero denominator becomes 1."""
    fit, keys = _fit_rows(df, fit_on, split), list(keys)
    if method == "robust":
        params = fit.select(*keys).distinct()
        for c in cols:
            params = join_null_safe(params, quantile_table(fit, keys, c, [0.25, 0.5, 0.75], prefix=f"_p_{c}_"), keys, "left")
    elif method == "standard":
        params = fit.groupBy(*keys).agg(*[x for c in cols for x in (F.avg(c).alias(f"_c_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    elif method == "minmax":
        params = fit.groupBy(*keys).agg(*[x for c in cols for x in (F.min(c).alias(f"_c_{c}"), F.max(c).alias(f"_x_{c}"))])
    else:
        raise ValueError(method)
    j = join_null_safe(df, maybe_broadcast(params), keys, "left")
    out = []
    for c in cols:
        if method == "robust":
            center, den = F.col(f"_p_{c}_1"), F.col(f"_p_{c}_2") - F.col(f"_p_{c}_0")
        elif method == "standard":
            center, den = F.col(f"_c_{c}"), F.col(f"_s_{c}")
        else:
            center, den = F.col(f"_c_{c}"), F.col(f"_x_{c}") - F.col(f"_c_{c}")
        den = F.when(den == 0, 1.0).otherwise(den)
        out.append(((F.col(c) - center) / den).alias(f"{c}_scaled"))
    return j.select(*df.columns, *out)


def _yj(x, lam):
    """Yeo-Johnson transform of column ``x`` for ``lam`` (a number or a column)."""
    lam = lam if not isinstance(lam, (int, float)) else F.lit(float(lam))
    pos = F.when(F.abs(lam) > 1e-12, (F.pow(x + 1, lam) - 1) / lam).otherwise(F.log1p(x))
    neg = F.when(F.abs(lam - 2) > 1e-12, -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam)).otherwise(-F.log1p(-x))
    return F.when(x >= 0, pos).otherwise(neg)


def _loglik(n, var, lam, slog):
    # Yeo-Johnson profile log-likelihood: -n/2 log(var) + (lam - 1) sum(sign(x) log1p|x|)
    return -n / 2 * F.log(var) + (lam - 1) * slog


def yeo_johnson_lambda(df: DataFrame, col: str, keys=KEYS, grid=None) -> DataFrame:
    """F-20 fit: maximum-likelihood lambda per group.

    Pass 1 evaluates a fixed grid (-2..4, step 0.25) as columns of ONE
    aggregate; passes 2 and 3 refine around each group's best value with
    steps 0.05 and 0.01 (11 candidates per group, exploded per row and
    reduced by partial aggregation).  Nothing is collected to the driver.
    """
    keys = list(keys)
    grid = list(grid or [i / 4 for i in range(-8, 17)])
    x = F.col(col).cast("double")
    return _lambdas(scratch_table(df.where(x.isNotNull()).select(*keys, x.alias("_x")), "values"), keys, grid)


def _lambdas(d: DataFrame, keys, grid) -> DataFrame:
    """The fit on a stored table of keys and non-null values ``_x``."""
    xv = F.col("_x")
    aggs = [F.count(xv).alias("_n"), F.sum(F.signum(xv) * F.log1p(F.abs(xv))).alias("_sl")]
    aggs += [F.var_pop(_yj(xv, lam)).alias(f"_v{i}") for i, lam in enumerate(grid)]
    a = d.groupBy(*keys).agg(*aggs)
    lls = [F.struct(_loglik(F.col("_n"), F.col(f"_v{i}"), F.lit(lam), F.col("_sl")).alias("ll"),
                    F.lit(lam).alias("lam")) for i, lam in enumerate(grid)]
    best = a.select(*keys, F.greatest(*lls)["lam"].alias("lam"))
    for step in (0.05, 0.01):
        cand = best.select(*keys, F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("_o"),
                           "lam").withColumn("_lam", F.col("lam") + F.col("_o") * step)
        j = join_null_safe(d, maybe_broadcast(cand), keys)
        r = j.groupBy(*keys, "_lam").agg(F.count(xv).alias("_n"),
                                          F.sum(F.signum(xv) * F.log1p(F.abs(xv))).alias("_sl"),
                                          F.var_pop(_yj(xv, F.col("_lam"))).alias("_v"))
        r = r.select(*keys, F.struct(_loglik(F.col("_n"), F.col("_v"), F.col("_lam"), F.col("_sl")).alias("ll"),
                                     F.col("_lam").alias("lam")).alias("_s"))
        best = r.groupBy(*keys).agg(F.max("_s")["lam"].alias("lam"))
    return best


def power_transform(df: DataFrame, col: str, keys=KEYS) -> DataFrame:
    """F-20: Yeo-Johnson with the fitted lambda, then standardised (pop std); all
    JVM-side column expressions.  Every row comes back; the rows of a group without a
    value have a null lambda and result.  The source is read once for the stored
    (keys, value) projection that all passes of the fit use, and once for the result."""
    keys, x = list(keys), F.col(col).cast("double")
    d = scratch_table(df.where(x.isNotNull()).select(*keys, x.alias("_x")), "values")
    lam = maybe_broadcast(_lambdas(d, keys, [i / 4 for i in range(-8, 17)]))
    t = join_null_safe(d, lam, keys).withColumn("_yj", _yj(F.col("_x"), F.col("lam")))
    params = t.groupBy(*keys).agg(F.first("lam").alias("lam"), F.avg("_yj").alias("_m"), F.stddev_pop("_yj").alias("_s"))
    j = join_null_safe(df, maybe_broadcast(params), keys, "left")
    den = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return j.select(*df.columns, "lam", ((_yj(x, F.col("lam")) - F.col("_m")) / den).alias(f"{col}_power"))
