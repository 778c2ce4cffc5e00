"""Load tests and strategy comparison (L-1..L-11).

Per-sample stability features (L-4, L-5) are bounded trailing windows over
each experiment; everything else is a one-pass ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantities import parse_cpu, parse_memory_gb
from .windows import CHUNK_ROWS, by_chunks, dense_position

# Collection interval of the strategy experiments and SLA limit.
SAMPLE_INTERVAL_S = 30
SLA_ERROR_LIMIT = 0.05
VOLATILITY_WINDOW = 10


def load_summary(requests: DataFrame, keys=("service",)) -> DataFrame:
    """L-1: totals, success rate, elapsed statistics and throughput
    ``n / (last - first timestamp in ms) * 1000``."""
    span = F.max("timeStamp") - F.min("timeStamp")
    return requests.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("success")).alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        (F.count_if(F.col("success")) / F.count("*") * 100).alias("success_rate"),
        F.avg("elapsed").alias("avg_response_time"),
        F.max("elapsed").alias("max_response_time"),
        F.min("elapsed").alias("min_response_time"),
        F.try_divide(F.count("*") * 1000.0, span).alias("throughput"))


def pod_cost(inventory: DataFrame, keys=("service",), interval_s: int = SAMPLE_INTERVAL_S) -> DataFrame:
    """L-2: requested cores and GiB summed over the pods of each key, their
    count, and the cost of one sampling interval (cpu-hours, memory-hours)."""
    hours = interval_s / 3600.0
    agg = inventory.groupBy(*keys).agg(
        F.sum(parse_cpu("cpu_request")).alias("cpu_cores"),
        F.sum(parse_memory_gb("memory_request")).alias("memory_gb"),
        F.count_distinct("container").alias("replica_count"))
    return agg.select(*keys, "cpu_cores", "memory_gb", "replica_count",
                      (F.col("cpu_cores") * hours).alias("cpu_hours"),
                      (F.col("memory_gb") * hours).alias("memory_hours"),
                      F.lit(hours).alias("elapsed_hours"))


def latency_histogram(requests: DataFrame, bounds, step: str = "1 hour", keys=("service",)) -> DataFrame:
    """Cumulative ``le`` buckets of request latency per (key, step window);
    the last bound is +Inf.  Feeds :func:`capstan.operators.series.histogram_quantile`."""
    lat = F.col("latency_s")
    aggs = [F.count_if(lat <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    per = requests.groupBy(*keys, F.window("ts", step).start.alias("ts")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").cast("long").alias("cumulative"))
                     for i, b in enumerate(bounds)])
    return per.select(*keys, "ts", F.inline(rows))


def performance_sample(requests: DataFrame, bounds, step: str = "1 hour", step_s: int = 3600,
                       keys=("service",)) -> DataFrame:
    """L-3: per (key, step) p95 / p50 latency from histogram buckets, error
    rate (5xx share), throughput (requests per second) and SLA compliance."""
    from .series import histogram_quantile

    hist = latency_histogram(requests, bounds, step, keys)
    p95 = histogram_quantile(hist, 0.95, keys).withColumnRenamed("quantile", "p95_latency")
    p50 = histogram_quantile(hist, 0.50, keys).withColumnRenamed("quantile", "avg_response_time")
    counts = requests.groupBy(*keys, F.window("ts", step).start.alias("ts")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status").rlike("^5..$")).alias("n5xx"))
    err = F.col("n5xx") / F.col("n")
    perf = counts.select(*keys, "ts", err.alias("error_rate"), (F.col("n") / float(step_s)).alias("throughput"))
    out = perf.join(p95, [*keys, "ts"], "left").join(p50, [*keys, "ts"], "left")
    sla = F.when(F.col("error_rate") < SLA_ERROR_LIMIT, 1.0 - F.col("error_rate")).otherwise(0.0)
    return out.select(*keys, "ts", F.coalesce("p95_latency", F.lit(0.0)).alias("p95_latency"),
                      F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
                      "error_rate", "throughput", sla.alias("sla_compliance"))


def _experiment_window(order=("ts", "seq")):
    return Window.partitionBy("experiment_id").orderBy(*order)


def stability_features(samples: DataFrame, n: int = VOLATILITY_WINDOW, order=("ts", "seq"),
                       chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """L-4 + L-5 in one window pass: volatility = sample stdev of the previous
    <= n cpu utilisation values (current excluded; 0 with fewer than 2), and
    scaling_event = replica count differs from the previous sample.

    Rows get a dense position per experiment (day-bucket row numbers plus
    offsets), and the windows run per position chunk with an n-row halo, so
    one long experiment never lands in a single task."""
    def run(d, parts):
        w = Window.partitionBy(*parts).orderBy(*order)
        prev = F.lag("replica_count").over(w)
        vol = F.coalesce(F.stddev_samp("cpu_utilization").over(w.rowsBetween(-n, -1)), F.lit(0.0))
        return d.withColumn("volatility", vol).withColumn(
            "scaling_event", F.coalesce(prev != F.col("replica_count"), F.lit(False)))
    if chunk_rows is None:
        return run(samples, ["experiment_id"])
    pos = dense_position(samples, ["experiment_id"], order, "_spos")
    return by_chunks(pos, ["experiment_id"], "_spos", n, run, chunk_rows).drop("_spos")


def experiment_summary(samples: DataFrame) -> DataFrame:
    """L-6: per experiment totals and averages.  p95 averages use positive
    values only (0 when none); average cores = cpu-hours / duration-hours;
    mean SLA compliance is kept as well."""
    s = stability_features(samples)
    p95 = F.col("p95_latency")
    sla = F.when(F.col("error_rate") < SLA_ERROR_LIMIT, 1.0 - F.col("error_rate")).otherwise(0.0)
    agg = s.groupBy("experiment_id", "service_name", "strategy", "status").agg(
        F.count("*").alias("data_points"),
        F.sum("elapsed_hours").alias("duration_hours"),
        F.sum(F.col("cpu_cores") * F.col("elapsed_hours")).alias("total_cpu_hours"),
        F.sum(F.col("memory_gb") * F.col("elapsed_hours")).alias("total_memory_hours"),
        F.coalesce(F.avg(F.when(p95 > 0, p95)), F.lit(0.0)).alias("avg_p95_latency"),
        F.coalesce(F.max(F.when(p95 > 0, p95)), F.lit(0.0)).alias("max_p95_latency"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.avg("throughput").alias("avg_throughput"),
        F.avg(sla).alias("avg_sla_compliance"),
        F.count_if("scaling_event").alias("scaling_events"),
        F.avg("volatility").alias("avg_volatility"),
        F.max("volatility").alias("max_volatility"))
    d = F.col("duration_hours")
    return agg.withColumn("avg_cpu_cores", F.when(d > 0, F.col("total_cpu_hours") / d).otherwise(0.0)) \
              .withColumn("avg_memory_gb", F.when(d > 0, F.col("total_memory_hours") / d).otherwise(0.0))


def _successful(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("status") == "success")


def _cost_aggs():
    return [F.avg("total_cpu_hours").alias("mean_cpu_hours"),
            F.avg("total_memory_hours").alias("mean_memory_hours"),
            F.avg("avg_cpu_cores").alias("mean_cpu_cores"),
            F.avg("avg_memory_gb").alias("mean_memory_gb")]


def _perf_aggs():
    return [F.avg("avg_p95_latency").alias("mean_p95_latency"),
            F.max("max_p95_latency").alias("max_p95_latency"),
            F.avg("avg_error_rate").alias("mean_error_rate"),
            F.avg("avg_throughput").alias("mean_throughput"),
            F.avg("avg_sla_compliance").alias("mean_sla_compliance")]


def _stab_aggs():
    return [F.avg("scaling_events").alias("mean_scaling_events"),
            F.sum("scaling_events").alias("total_scaling_events"),
            F.avg("avg_volatility").alias("mean_volatility"),
            F.max("max_volatility").alias("max_volatility")]


def cost_by_strategy(summary: DataFrame) -> DataFrame:
    """L-7: mean cost figures of successful experiments per strategy."""
    return _successful(summary).groupBy("strategy").agg(*_cost_aggs())


def savings(cost: DataFrame, baseline: str = "statistical", candidate: str = "predictive") -> DataFrame:
    """L-8: % saved by ``candidate`` against ``baseline`` (0 when baseline <= 0).
    Empty when either strategy is missing."""
    def pick(strategy, col):
        return F.max(F.when(F.col("strategy") == strategy, F.col(col)))

    one = cost.agg(pick(baseline, "mean_cpu_hours").alias("b_cpu"), pick(candidate, "mean_cpu_hours").alias("c_cpu"),
                   pick(baseline, "mean_memory_hours").alias("b_mem"),
                   pick(candidate, "mean_memory_hours").alias("c_mem"))
    cpu = F.when(F.col("b_cpu") > 0, (F.col("b_cpu") - F.col("c_cpu")) / F.col("b_cpu") * 100).otherwise(0.0)
    mem = F.when(F.col("b_mem") > 0, (F.col("b_mem") - F.col("c_mem")) / F.col("b_mem") * 100).otherwise(0.0)
    return (one.where(F.col("b_cpu").isNotNull() & F.col("c_cpu").isNotNull())
            .select(F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"),
                    cpu.alias("cpu_savings_percent"), mem.alias("memory_savings_percent"),
                    ((cpu + mem) / 2.0).alias("overall_savings_percent")))


def performance_by_strategy(summary: DataFrame) -> DataFrame:
    """L-9: latency, errors, throughput (and SLA, D-16) per strategy."""
    return _successful(summary).groupBy("strategy").agg(*_perf_aggs())


def stability_by_strategy(summary: DataFrame) -> DataFrame:
    """L-10: scaling events and volatility per strategy."""
    return _successful(summary).groupBy("strategy").agg(*_stab_aggs())


def strategy_report(summary: DataFrame) -> DataFrame:
    """L-11: L-7, L-9 and L-10 side by side per strategy, computed in ONE
    aggregate over the experiment summaries (no re-scan, no joins)."""
    return _successful(summary).groupBy("strategy").agg(*_cost_aggs(), *_perf_aggs(), *_stab_aggs())
