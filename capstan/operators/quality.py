"""Data quality checks of experiments (G-1..G-5).

Each check keeps one row per (experiment, check, metric) so that no detail is
overwritten (reference defect D-7); the verdict joins them per experiment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .experiments import latest_window

# Quality defaults.
REQUIRED_METRICS = ["cpu", "mem", "requests_per_second"]
CRITICAL_METRICS = ["cpu_cores", "mem_bytes", "requests_per_second"]
MIN_COMPLETENESS_PCT = 90.0
MAX_NULL_PCT = 5.0
MAX_CV_PCT = 10.0
STABILITY_TAIL = 20
STABILITY_MIN_ROWS = 10
STABILITY_MIN_VALUES = 5
STALE_AFTER_S = 3600


def completeness(samples: DataFrame, keys, required=REQUIRED_METRICS,
                 min_pct: float = MIN_COMPLETENESS_PCT) -> DataFrame:
    """G-1: share of required metric names found as a substring of some
    collected metric name, per key.  One aggregate (one flag per required
    name), no join."""
    names = samples.select(*keys, "metric").distinct()
    flags = [F.max(F.col("metric").contains(r).cast("int")).alias(f"_r{i}") for i, r in enumerate(required)]
    agg = names.groupBy(*keys).agg(*flags)
    found = reduce(lambda a, b: a + b, [F.col(f"_r{i}") for i in range(len(required))])
    pct = found / float(len(required)) * 100
    return agg.select(*keys, found.alias("found"), F.lit(len(required)).alias("required"),
                      pct.alias("completeness_pct"), (pct >= min_pct).alias("passed"))


def null_share(wide: DataFrame, keys, columns, max_pct: float = MAX_NULL_PCT) -> DataFrame:
    """G-2: NULL % per (key, metric column); one aggregate, then unpivot."""
    aggs = [(F.sum(F.col(c).isNull().cast("int")) / F.count("*") * 100).alias(c) for c in columns]
    per = wide.groupBy(*keys).agg(*aggs)
    long = per.unpivot(list(keys), list(columns), "metric", "null_pct")
    return long.withColumn("passed", F.col("null_pct") <= max_pct)


def stability_cv(wide: DataFrame, keys, columns, order=("idx",), max_pct: float = MAX_CV_PCT,
                 tail: int = STABILITY_TAIL) -> DataFrame:
    """G-3: coefficient of variation (sample stdev / mean x 100) of the last
    ``tail`` rows per (key, metric).  Needs >= 10 rows, >= 5 non-null values
    and a positive mean; otherwise the check is not applicable (NULL)."""
    n = wide.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    last = latest_window(wide, keys, tail, order)
    long = last.unpivot(list(keys), list(columns), "metric", "value")
    agg = long.groupBy(*keys, "metric").agg(F.count("value").alias("n_values"),
                                             F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    j = agg.join(n, list(keys))
    ok = (F.col("n_rows") >= STABILITY_MIN_ROWS) & (F.col("n_values") >= STABILITY_MIN_VALUES) & (F.col("mean") > 0)
    cv = F.when(ok, F.col("std") / F.col("mean") * 100)
    return j.select(*keys, "metric", cv.alias("cv_pct"), F.when(ok, cv <= max_pct).alias("passed"))


def quality_verdict(complete: DataFrame, nulls: DataFrame, stability: DataFrame, keys) -> DataFrame:
    """G-4: per key ``failed`` (no metrics), ``warnings`` (any failed check)
    or ``passed``; experiment status ``completed`` / ``completed_with_warnings``;
    warning messages as an array."""
    keys = list(keys)
    c = complete.select(*keys, F.col("found"), F.col("passed").alias("_c_ok"), "completeness_pct")
    nmsg = nulls.groupBy(*keys).agg(
        F.count_if(~F.col("passed")).alias("_n_bad"),
        F.collect_list(F.when(~F.col("passed"), F.format_string("High NULL share in %s: %.1f%%",
                                                                 "metric", "null_pct"))).alias("_n_msgs"))
    smsg = stability.groupBy(*keys).agg(
        F.count_if(F.col("passed") == F.lit(False)).alias("_s_bad"),
        F.collect_list(F.when(F.col("passed") == F.lit(False),
                              F.format_string("High variability in %s: CV=%.1f%%", "metric", "cv_pct")))
        .alias("_s_msgs"))
    j = c.join(nmsg, keys, "full").join(smsg, keys, "full")
    bad = (F.coalesce(~F.col("_c_ok"), F.lit(False)).cast("int") + F.coalesce(F.col("_n_bad"), F.lit(0))
           + F.coalesce(F.col("_s_bad"), F.lit(0)))
    verdict = (F.when(F.coalesce(F.col("found"), F.lit(0)) == 0, "failed")
               .when(bad > 0, "warnings").otherwise("passed"))
    cmsg = F.when(~F.col("_c_ok"), F.array(F.format_string("Low data completeness: %.1f%%", "completeness_pct")))
    msgs = F.concat(F.coalesce(cmsg, F.array().cast("array<string>")),
                    F.coalesce("_n_msgs", F.array().cast("array<string>")),
                    F.coalesce("_s_msgs", F.array().cast("array<string>")))
    return j.select(*keys, verdict.alias("quality"), bad.alias("n_warnings"), msgs.alias("warnings"),
                    F.when(verdict == "failed", "failed").when(verdict == "warnings", "completed_with_warnings")
                    .otherwise("completed").alias("status"))


def freshness(wanted: DataFrame, inventory: DataFrame, samples: DataFrame, now: str,
              name: str = "service", cpu_metric: str = "cpu_cores", mem_metric: str = "mem_bytes",
              stale_after_s: int = STALE_AFTER_S) -> DataFrame:
    """G-5: per wanted service - no inventory -> invalid; no cpu / memory rows
    -> warning; newest sample older than ``stale_after_s`` before ``now``
    -> warning.  ``now`` is an argument, so results repeat."""
    inv = inventory.select(F.col(name)).distinct().withColumn("_inv", F.lit(True))
    per = samples.groupBy(name).agg(
        F.count_if(F.col("metric") == cpu_metric).alias("_cpu"),
        F.count_if(F.col("metric") == mem_metric).alias("_mem"),
        F.max("ts").alias("last_ts"))
    j = wanted.select(name).join(inv, name, "left").join(per, name, "left")
    age_s = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    warns = F.array_compact(F.array(
        F.when(F.coalesce("_cpu", F.lit(0)) == 0, F.lit("No CPU metrics data")),
        F.when(F.coalesce("_mem", F.lit(0)) == 0, F.lit("No memory metrics data")),
        F.when(age_s > stale_after_s, F.lit("Data is stale"))))
    return j.select(name, F.coalesce("_inv", F.lit(False)).alias("is_valid"),
                    F.when(F.col("_inv").isNull(), F.array(F.lit("No deployment information found")))
                    .otherwise(F.array().cast("array<string>")).alias("issues"),
                    warns.alias("warnings"), age_s.alias("age_seconds"))
