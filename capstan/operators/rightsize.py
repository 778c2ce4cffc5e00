"""Statistical rightsizing (R-1..R-7).

Profiles are one ``groupBy`` per key over the samples (partial aggregation
map-side, one shuffle on the key).  The recommendation joins the profile to the
container inventory; the profile has one row per service, so it is broadcast
behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantities import (MIN_CPU_CORES, MIN_MEMORY_BYTES, format_cpu,
                                    format_memory, parse_cpu, parse_memory)
from ..session import maybe_broadcast
from .windows import join_null_safe

# Defaults of the statistical strategy and its validation bounds.
CPU_PERCENTILE = 95.0
MEMORY_BUFFER_PCT = 15.0
CPU_WARN_LOW, CPU_WARN_HIGH = 0.01, 8.0
MEM_WARN_LOW, MEM_WARN_HIGH = 32 * 1024 ** 2, 32 * 1024 ** 3


def _with_quantiles(base: DataFrame, values: DataFrame, keys, names: dict[str, float], mode: str) -> DataFrame:
    """``base`` (one row per key) with quantiles of ``values.value`` joined."""
    from .quantiles import quantile_table
    q = quantile_table(values, keys, "value", list(names.values()), mode, "_q")
    q = q.select(*keys, *[F.col(f"_q{i}").alias(n) for i, n in enumerate(names)])
    return join_null_safe(base, q, list(keys), "left")  # one row a key on both sides


def usage_profile_cpu(samples: DataFrame, keys=("service",), value: str = "value",
                      percentile: float = CPU_PERCENTILE, mode: str = "exact") -> DataFrame:
    """R-1: percentile + mean/median/std/min/max/count of cpu usage per key.

    Quantiles are exact (linear interpolation, as pandas) with bounded memory
    per group (:mod:`capstan.operators.quantiles`); ``mode='approx'`` uses
    ``percentile_approx``.  NULL values are skipped, as ``dropna`` does.
    """
    keys = list(keys)
    clean = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    v = F.col("value")
    base = clean.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                                    F.max(v).alias("max"), F.count(v).alias("count"))
    out = _with_quantiles(base, clean, keys, {"percentile_value": percentile / 100.0, "median": 0.5}, mode)
    return out.select(*keys, "percentile_value", "mean", "median", "std", "min", "max", "count")


def usage_profile_memory(samples: DataFrame, keys=("service",), value: str = "value",
                         mode: str = "exact") -> DataFrame:
    """R-3: max + the same statistics for memory usage."""
    keys = list(keys)
    clean = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    v = F.col("value")
    base = clean.groupBy(*keys).agg(F.max(v).alias("max_usage_bytes"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                    F.min(v).alias("min"), F.count(v).alias("count"))
    out = _with_quantiles(base, clean, keys, {"median": 0.5}, mode)
    return out.select(*keys, "max_usage_bytes", "mean", "median", "std", "min", "count")


def recommend_cpu_expr(percentile_value: Column) -> Column:
    """R-2 core: max(p, 0.1) cores, 0.1 when there is no data."""
    return F.greatest(F.coalesce(percentile_value, F.lit(0.0)), F.lit(MIN_CPU_CORES))


def recommend_memory_expr(max_usage: Column, buffer_pct: float = MEMORY_BUFFER_PCT) -> Column:
    """R-4 core: int(max * (1 + buffer)), floor 128 Mi; 128 Mi when there is no data."""
    raw = (F.coalesce(max_usage, F.lit(0.0)) * (1 + buffer_pct / 100.0)).cast("long")
    return F.greatest(raw, F.lit(MIN_MEMORY_BYTES).cast("long"))


def recommend_cpu(services: DataFrame, cpu_samples: DataFrame, key: str = "service",
                  percentile: float = CPU_PERCENTILE, mode: str = "exact") -> DataFrame:
    """R-2 per service: services without samples keep a row with has_data false."""
    prof = usage_profile_cpu(cpu_samples, (key,), percentile=percentile, mode=mode)
    j = join_null_safe(services.select(key).distinct(), prof, [key], "left")
    cores = recommend_cpu_expr(F.col("percentile_value"))
    return j.select(
        key,
        F.coalesce("percentile_value", F.lit(0.0)).alias("percentile_value"),
        cores.alias("recommended_cores"),
        format_cpu(cores).alias("recommended_cpu"),
        F.col("count").isNotNull().alias("has_data"))


def recommend_memory(services: DataFrame, mem_samples: DataFrame, key: str = "service",
                     buffer_pct: float = MEMORY_BUFFER_PCT) -> DataFrame:
    """R-4 per service."""
    prof = mem_samples.where(F.col("value").isNotNull()).groupBy(key).agg(
        F.max("value").alias("max_usage_bytes"), F.count("value").alias("count"))
    j = join_null_safe(services.select(key).distinct(), prof, [key], "left")
    b = recommend_memory_expr(F.col("max_usage_bytes"), buffer_pct)
    return j.select(
        key,
        F.coalesce("max_usage_bytes", F.lit(0.0)).alias("max_usage_bytes"),
        b.alias("recommended_bytes"),
        format_memory(b).alias("recommended_memory"),
        F.col("count").isNotNull().alias("has_data"))


def recommendations(inventory: DataFrame, samples: DataFrame, key: str = "service",
                    cpu_metric: str = "cpu_cores", mem_metric: str = "mem_bytes",
                    percentile: float = CPU_PERCENTILE, buffer_pct: float = MEMORY_BUFFER_PCT,
                    mode: str = "exact") -> DataFrame:
    """R-5: one row per container: current vs recommended requests + analysis.

    The plain statistics of both profiles come from ONE aggregation over the long
    samples table (conditional aggregates on ``metric``); the cpu percentile is
    exact with bounded memory.  Service-level usage repeats for each container of
    the service.
    """
    v = F.col("value")
    cpu_v = F.when(F.col("metric") == cpu_metric, v)
    mem_v = F.when(F.col("metric") == mem_metric, v)
    rows = samples.where(F.col("metric").isin(cpu_metric, mem_metric) & v.isNotNull())
    base = rows.groupBy(key).agg(
        F.avg(cpu_v).alias("cpu_mean"), F.max(cpu_v).alias("cpu_max"), F.count(cpu_v).alias("cpu_count"),
        F.max(mem_v).alias("mem_max_usage_bytes"), F.avg(mem_v).alias("mem_mean"), F.count(mem_v).alias("mem_count"))
    cpu = rows.where(F.col("metric") == cpu_metric).select(key, v.cast("double").alias("value"))
    prof = _with_quantiles(base, cpu, [key], {"cpu_percentile_value": percentile / 100.0}, mode)
    cores = recommend_cpu_expr(F.col("cpu_percentile_value"))
    mem_b = recommend_memory_expr(F.col("mem_max_usage_bytes"), buffer_pct)
    j = join_null_safe(inventory, maybe_broadcast(prof), [key], "left")
    return j.select(
        F.col(key).alias("service"), "namespace", "container",
        F.lit("statistical").alias("strategy"),
        F.col("cpu_request").alias("current_cpu"),
        F.col("memory_request").alias("current_memory"),
        format_cpu(cores).alias("recommended_cpu"),
        format_memory(mem_b).alias("recommended_memory"),
        F.coalesce("cpu_percentile_value", F.lit(0.0)).alias("cpu_percentile_value"),
        F.coalesce("mem_max_usage_bytes", F.lit(0.0)).alias("mem_max_usage_bytes"),
        (F.coalesce("cpu_count", F.lit(0)) > 0).alias("cpu_has_data"),
        (F.coalesce("mem_count", F.lit(0)) > 0).alias("mem_has_data"),
        F.lit(percentile).alias("cpu_percentile"),
        F.lit(buffer_pct).alias("memory_buffer_percentage"))


def recommendations_nested(recs: DataFrame) -> DataFrame:
    """R-5 nested view: current / recommended / parameters as structs."""
    return recs.select(
        "service", "namespace", "container", "strategy",
        F.struct(F.col("cpu_percentile").alias("cpu_percentile"),
                 F.col("memory_buffer_percentage").alias("memory_buffer_percentage")).alias("parameters"),
        F.struct(F.col("current_cpu").alias("cpu"), F.col("current_memory").alias("memory")).alias("current_requests"),
        F.struct(F.col("recommended_cpu").alias("cpu"),
                 F.col("recommended_memory").alias("memory")).alias("recommended_requests"),
        F.struct(F.struct(F.col("cpu_percentile_value").alias("percentile_value"),
                          F.col("cpu_has_data").alias("has_data")).alias("cpu"),
                 F.struct(F.col("mem_max_usage_bytes").alias("max_usage_bytes"),
                          F.col("mem_has_data").alias("has_data")).alias("memory")).alias("analysis"))


def validate_recommendations(recs: DataFrame) -> DataFrame:
    """R-6: per container warnings from the formatted recommendation texts."""
    cpu = parse_cpu(F.col("recommended_cpu"))
    mem = parse_memory(F.col("recommended_memory"))
    warn_cpu = (F.when(cpu < CPU_WARN_LOW, F.concat(F.lit("Very low CPU recommendation for "),
                                                   F.col("container"), F.lit(": "), cpu.cast("string")))
                .when(cpu > CPU_WARN_HIGH, F.concat(F.lit("High CPU recommendation for "), F.col("container"),
                                                    F.lit(": "), cpu.cast("string"), F.lit(" cores"))))
    warn_mem = (F.when(mem < MEM_WARN_LOW, F.concat(F.lit("Very low memory recommendation for "),
                                                   F.col("container"), F.lit(": "), F.col("recommended_memory")))
                .when(mem > MEM_WARN_HIGH, F.concat(F.lit("Very high memory recommendation for "),
                                                    F.col("container"), F.lit(": "), F.col("recommended_memory"))))
    return recs.select(
        "service", "container", "recommended_cpu", "recommended_memory",
        cpu.alias("recommended_cores"), mem.alias("recommended_bytes"),
        F.array_compact(F.array(warn_cpu, warn_mem)).alias("warnings"),
        (F.when(cpu < CPU_WARN_LOW, "low_cpu").when(cpu > CPU_WARN_HIGH, "high_cpu")).alias("cpu_flag"),
        (F.when(mem < MEM_WARN_LOW, "low_memory").when(mem > MEM_WARN_HIGH, "high_memory")).alias("memory_flag"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """R-6 overall: is_valid + number of warnings (errors cannot occur: parsing is total)."""
    return validated.agg(
        F.lit(True).alias("is_valid"),
        F.sum(F.size("warnings")).cast("long").alias("n_warnings"),
        F.count("*").alias("n_recommendations"))


def resource_delta(recs: DataFrame) -> DataFrame:
    """R-7: current vs recommended per (container, resource), in cores / bytes."""
    rows = F.array(
        F.struct(F.lit("cpu").alias("resource"), F.col("current_cpu").alias("current"),
                 F.col("recommended_cpu").alias("recommended"),
                 parse_cpu("current_cpu").alias("current_value"),
                 parse_cpu("recommended_cpu").alias("recommended_value")),
        F.struct(F.lit("memory").alias("resource"), F.col("current_memory").alias("current"),
                 F.col("recommended_memory").alias("recommended"),
                 parse_memory("current_memory").cast("double").alias("current_value"),
                 parse_memory("recommended_memory").cast("double").alias("recommended_value")))
    out = recs.select("service", "container", F.inline(rows))
    return out.withColumn("change", F.col("recommended_value") - F.col("current_value"))
