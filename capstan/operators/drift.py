"""Drift between two samples of features: Kolmogorov-Smirnov and population stability.

Both samples are first counted by value (ties are one row, counted before the
shuffle), so a hot feature is as small as its distinct values.  The distribution
functions are running sums over the values of both samples together, in parts of
bounded size for long series, and in whole numbers: the difference of the two is
the running sum of ``c_ref * n_cur - c_cur * n_ref``, over ``n_ref * n_cur``.

Null values are no observations; a null key or feature is a group.  A group that
one of the samples lacks has null statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast, scratch_table
from .quantiles import quantile_table
from .windows import CHUNK_ROWS, join_null_safe, sum_before

# The usual limits of the stability index, and the significance level.
PSI_MODERATE, PSI_SIGNIFICANT, ALPHA = 0.1, 0.25, 0.05
#: Share that an empty bin counts as.
PSI_FLOOR = 1e-4
#: Below this the distribution of the statistic is 1 to twelve digits.
SMALL_LAMBDA, TERMS = 0.2, 100


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of a two-sample Kolmogorov-Smirnov distance."""
    square = d * d * (n * m / (n + m))
    j = F.sequence(F.lit(1), F.lit(TERMS))
    series = F.aggregate(j, F.lit(0.0), lambda acc, x: acc + F.when(x % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * x * x * square))
    p = F.when(square < SMALL_LAMBDA ** 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return F.when(square.isNotNull(), p)


def drift(reference: DataFrame, current: DataFrame, keys=("service", "feature"), value: str = "value", bins: int = 10,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a group: ``n_ref``, ``n_cur``, ``ks``, ``ks_p``, ``psi`` over ``bins``
    quantile bins of the reference, ``drifted`` (p under 5 %) and ``level``
    (stable, moderate, significant)."""
    keys = list(keys)

    def side(df: DataFrame, ref: int) -> DataFrame:
        return df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.lit(ref).alias("_ref"))

    both = side(reference, 1).unionByName(side(current, 0))
    counts = scratch_table(both.groupBy(*keys, "_v").agg(F.sum("_ref").alias("_r"), F.sum(1 - F.col("_ref")).alias("_c")), "values")
    sizes = counts.groupBy(*keys).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))

    d = join_null_safe(counts, maybe_broadcast(sizes), keys)
    big = "decimal(38,0)"
    step = F.col("_r").cast("decimal(18,0)") * F.col("n_cur").cast("decimal(18,0)") - F.col("_c").cast("decimal(18,0)") * F.col("n_ref").cast("decimal(18,0)")
    d = sum_before(d.withColumn("_step", step.cast(big)), keys, ["_v"], "_step", "_upto", chunk_rows)
    gap = F.max(F.abs(F.col("_upto").cast(big) + F.col("_step"))).cast("double")
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    ks = d.groupBy(*keys).agg(F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"), gap.alias("_gap"))
    ks = ks.withColumn("ks", F.when((n > 0) & (m > 0), F.col("_gap") / (n * m))).drop("_gap")

    qs = [i / bins for i in range(1, bins)]
    edges = quantile_table(reference.where(F.col(value).isNotNull()), keys, value, qs, prefix="_e")
    edges = edges.select(*keys, F.array(*[f"_e{i}" for i in range(bins - 1)]).alias("_edges"))
    placed = join_null_safe(counts, maybe_broadcast(edges), keys)
    bin_ = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    held = placed.groupBy(*keys, bin_.alias("_bin")).agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    held = join_null_safe(held, maybe_broadcast(sizes), keys)
    p, q = (F.greatest(F.try_divide(F.col(c).cast("double"), t), F.lit(PSI_FLOOR)) for c, t in (("_r", n), ("_c", m)))
    psi = held.groupBy(*keys).agg(F.when(F.first("n_cur") > 0, F.sum((q - p) * F.log(q / p))).alias("psi"))

    out = join_null_safe(ks, psi, keys, "left").withColumn("ks_p", ks_p_value(F.col("ks"), n, m))
    level = F.when(F.col("psi") >= PSI_SIGNIFICANT, "significant").when(F.col("psi") >= PSI_MODERATE, "moderate").when(F.col("psi").isNotNull(), "stable")
    return out.select(*keys, "n_ref", "n_cur", "ks", "ks_p", "psi", (F.col("ks_p") < ALPHA).alias("drifted"), level.alias("level"))
