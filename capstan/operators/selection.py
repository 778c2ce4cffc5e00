"""Feature selection by variance, mutual information with a target, and redundancy.

All columns are binned between their least and greatest value, and the joint counts
of the wanted pairs of columns come from one aggregate: every row gives one (pair,
bin, bin) for each pair, added up before the shuffle, so what moves is at most
``bins`` squared rows a pair and task.  Mutual information follows from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import correlation

# Limits of the selection and the most features it keeps.
VARIANCE_LIMIT, CORRELATION_LIMIT, INFORMATION_LIMIT, MAX_FEATURES = 0.01, 0.95, 0.01, 100
BINS = 16


def joint_counts(df: DataFrame, pairs: list[tuple[str, str]], bins: int = BINS) -> DataFrame:
    """``a``, ``b`` (a pair of columns), ``x``, ``y`` (their bins from 0) and ``n`` (rows
    in which both are present).  A constant column has one bin."""
    columns = sorted({c for p in pairs for c in p})
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_j{k}") for k, c in enumerate(columns)])
    ends = data.agg(*[f(f"_j{k}") for k in range(len(columns)) for f in (F.min, F.max)]).first()

    def bin_of(c: str):
        k = columns.index(c)
        low, high = ends[2 * k], ends[2 * k + 1]
        if low is None or high == low:
            return F.when(F.col(f"_j{k}").isNotNull(), 0)
        place = F.least(F.floor((F.col(f"_j{k}") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
        return F.when(F.col(f"_j{k}").isNotNull(), place)

    data = data.select(*[bin_of(c).alias(f"_b{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_b{columns.index(a)}").alias("x"), F.col(f"_b{columns.index(b)}").alias("y"))
                     for k, (a, b) in enumerate(pairs)])
    counts = data.select(F.inline(rows)).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("k", "x", "y").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return counts.withColumn("_p", F.get(names, F.col("k"))).select("_p.a", "_p.b", "x", "y", "n")


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]], bins: int = BINS) -> DataFrame:
    """``a``, ``b``, ``n`` and ``mutual_info`` (nats) of the binned columns."""
    c = joint_counts(df, pairs, bins)  # at most bins squared rows a pair
    n_x, n_y, n = (F.sum("n").over(Window.partitionBy("a", "b", *k)) for k in (["x"], ["y"], []))
    c = c.select("a", "b", "n", n_x.alias("_x"), n_y.alias("_y"), n.alias("_n"))
    share = F.col("n") / F.col("_n")
    term = share * F.log(F.col("n").cast("double") * F.col("_n") / (F.col("_x").cast("double") * F.col("_y")))
    return c.groupBy("a", "b").agg(F.max("_n").alias("n"), F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"))


def select_features(df: DataFrame, features: list[str], target: str, variance_limit: float = VARIANCE_LIMIT,
                    correlation_limit: float = CORRELATION_LIMIT, information_limit: float = INFORMATION_LIMIT,
                    max_features: int = MAX_FEATURES, bins: int = BINS) -> DataFrame:
    """One row a feature: ``variance``, ``mutual_info`` with the target, ``reason``
    (kept, low variance, low information, redundant, surplus) and ``kept_as``, the kept
    feature that it repeats.  Features are taken by falling information, then name;
    one that correlates with a kept one at the limit or beyond is redundant."""
    spark = df.sparkSession
    variances = df.agg(*[F.var_samp(F.col(f"`{f}`").cast("double")) for f in features]).first()
    variance = {f: v or 0.0 for f, v in zip(features, variances)}
    info = {r["a"]: r["mutual_info"] for r in mutual_information(df, [(f, target) for f in features], bins).collect()}  # one row a feature
    info = {f: info.get(f, 0.0) for f in features}
    r = correlation(df, features)
    kept, reason, repeats = [], {}, {}
    for f in sorted(features, key=lambda f: (-round(info[f], 9), f)):
        like = next((k for k in kept if abs(r[features.index(f), features.index(k)]) >= correlation_limit), None)
        reason[f] = ("low variance" if variance[f] < variance_limit else "low information" if info[f] < information_limit
                     else "redundant" if like else "surplus" if len(kept) >= max_features else "kept")
        if reason[f] == "kept":
            kept.append(f)
        elif reason[f] == "redundant":
            repeats[f] = like
    rows = [(f, variance[f], info[f], reason[f], repeats.get(f)) for f in features]
    return spark.createDataFrame(rows, "feature string, variance double, mutual_info double, reason string, kept_as string")
