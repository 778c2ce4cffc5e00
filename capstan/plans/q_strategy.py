"""Registered queries: load tests and strategy comparison (L-1..L-11)."""

from __future__ import annotations

from ..operators import strategy as st
from ..sources import adapters as ad
from . import sqlfn as S
from .q_series import _hq_sql
from .registry import register

BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, float("inf")]


@register("load_summary", adapters=["http"],
          floats=["success_rate", "avg_response_time", "throughput"], sql="""
    SELECT service, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests,
           count(*) FILTER (WHERE NOT success) AS failed_requests,
           count(*) FILTER (WHERE success) / count(*) * 100 AS success_rate,
           avg(elapsed) AS avg_response_time, max(elapsed) AS max_response_time,
           min(elapsed) AS min_response_time,
           CASE WHEN max("timeStamp") = min("timeStamp") THEN NULL
                ELSE count(*) * 1000.0 / (max("timeStamp") - min("timeStamp")) END AS throughput
    FROM http GROUP BY service""")
def load_summary(spark, sf):
    """L-1: request-log summary per service."""
    return st.load_summary(ad.http(spark, sf))


@register("pod_cost", adapters=["containers"],
          floats=["cpu_cores", "memory_gb", "cpu_hours", "memory_hours", "elapsed_hours"], sql=f"""
    SELECT service, sum({S.parse_cpu('cpu_request')}) AS cpu_cores,
           sum({S.parse_memory_gb('memory_request')}) AS memory_gb,
           count(DISTINCT container) AS replica_count,
           sum({S.parse_cpu('cpu_request')}) * (30 / 3600.0) AS cpu_hours,
           sum({S.parse_memory_gb('memory_request')}) * (30 / 3600.0) AS memory_hours,
           30 / 3600.0 AS elapsed_hours
    FROM containers GROUP BY service""")
def pod_cost(spark, sf):
    """L-2: requested resources and interval cost per service."""
    return st.pod_cost(ad.containers(spark, sf))


_HIST = " UNION ALL ".join(
    f"SELECT service, ts, {('inf' if b == float('inf') else b)!r}::DOUBLE AS le, "
    f"CAST(count(*) FILTER (WHERE latency_s <= {('inf' if b == float('inf') else b)!r}::DOUBLE) AS BIGINT) "
    f"AS cumulative FROM (SELECT service, date_trunc('hour', ts) AS ts, latency_s FROM http) h GROUP BY 1, 2"
    for b in BOUNDS)


@register("performance_sample", adapters=["http"],
          floats=["p95_latency", "avg_response_time", "error_rate", "throughput", "sla_compliance"], sql=f"""
    WITH hist AS ({_HIST}),
    p95 AS ({_hq_sql('hist', 0.95)}),
    p50 AS ({_hq_sql('hist', 0.5)}),
    c AS (SELECT service, date_trunc('hour', ts) AS ts, count(*) AS n,
                 count(*) FILTER (WHERE regexp_full_match(status, '5..')) AS n5 FROM http GROUP BY 1, 2)
    SELECT c.service, c.ts, coalesce(p95.quantile, 0.0) AS p95_latency,
           coalesce(p50.quantile, 0.0) AS avg_response_time, n5 / n AS error_rate, n / 3600.0 AS throughput,
           CASE WHEN n5 / n < 0.05 THEN 1.0 - n5 / n ELSE 0.0 END AS sla_compliance
    FROM c LEFT JOIN p95 ON c.service = p95.service AND c.ts = p95.ts
           LEFT JOIN p50 ON c.service = p50.service AND c.ts = p50.ts""")
def performance_sample(spark, sf):
    """L-3: hourly p95 / p50 (from histogram buckets), errors, throughput, SLA."""
    return st.performance_sample(ad.http(spark, sf), BOUNDS)


_STAB_SQL = """
    SELECT *, coalesce(stddev_samp(cpu_utilization) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0)
                AS volatility,
           coalesce(lag(replica_count) OVER w <> replica_count, false) AS scaling_event
    FROM strategy_samples WINDOW w AS (PARTITION BY experiment_id ORDER BY ts, seq)"""


@register("stability_features", adapters=["strategy_samples"], floats=["cpu_utilization", "volatility"], sql=f"""
    SELECT experiment_id, seq, replica_count, cpu_utilization, volatility, scaling_event FROM ({_STAB_SQL}) s""")
def stability_features(spark, sf):
    """L-4 + L-5: volatility of the previous 10 samples and scaling events."""
    s = st.stability_features(ad.strategy_samples(spark, sf))
    return s.select("experiment_id", "seq", "replica_count", "cpu_utilization", "volatility", "scaling_event")


_SUMMARY_SQL = f"""
    SELECT experiment_id, service_name, strategy, status, count(*) AS data_points,
           sum(elapsed_hours) AS duration_hours,
           sum(cpu_cores * elapsed_hours) AS total_cpu_hours, sum(memory_gb * elapsed_hours) AS total_memory_hours,
           coalesce(avg(p95_latency) FILTER (WHERE p95_latency > 0), 0.0) AS avg_p95_latency,
           coalesce(max(p95_latency) FILTER (WHERE p95_latency > 0), 0.0) AS max_p95_latency,
           avg(error_rate) AS avg_error_rate, avg(throughput) AS avg_throughput,
           avg(CASE WHEN error_rate < 0.05 THEN 1.0 - error_rate ELSE 0.0 END) AS avg_sla_compliance,
           count(*) FILTER (WHERE scaling_event) AS scaling_events,
           avg(volatility) AS avg_volatility, max(volatility) AS max_volatility,
           CASE WHEN sum(elapsed_hours) > 0 THEN sum(cpu_cores * elapsed_hours) / sum(elapsed_hours) ELSE 0.0 END
             AS avg_cpu_cores,
           CASE WHEN sum(elapsed_hours) > 0 THEN sum(memory_gb * elapsed_hours) / sum(elapsed_hours) ELSE 0.0 END
             AS avg_memory_gb
    FROM ({_STAB_SQL}) s GROUP BY experiment_id, service_name, strategy, status"""

_SUMMARY_FLOATS = ["duration_hours", "total_cpu_hours", "total_memory_hours", "avg_p95_latency", "max_p95_latency",
                   "avg_error_rate", "avg_throughput", "avg_sla_compliance", "avg_volatility", "max_volatility",
                   "avg_cpu_cores", "avg_memory_gb"]


def _summary(spark, sf):
    return st.experiment_summary(ad.strategy_samples(spark, sf))


@register("experiment_summary", adapters=["strategy_samples"], floats=_SUMMARY_FLOATS, sql=_SUMMARY_SQL)
def experiment_summary(spark, sf):
    """L-6: per-experiment summary."""
    return _summary(spark, sf)


_COST = """avg(total_cpu_hours) AS mean_cpu_hours, avg(total_memory_hours) AS mean_memory_hours,
           avg(avg_cpu_cores) AS mean_cpu_cores, avg(avg_memory_gb) AS mean_memory_gb"""
_PERF = """avg(avg_p95_latency) AS mean_p95_latency, max(max_p95_latency) AS max_p95_latency,
           avg(avg_error_rate) AS mean_error_rate, avg(avg_throughput) AS mean_throughput,
           avg(avg_sla_compliance) AS mean_sla_compliance"""
_STAB = """avg(scaling_events) AS mean_scaling_events, CAST(sum(scaling_events) AS BIGINT) AS total_scaling_events,
           avg(avg_volatility) AS mean_volatility, max(max_volatility) AS max_volatility"""
_COST_F = ["mean_cpu_hours", "mean_memory_hours", "mean_cpu_cores", "mean_memory_gb"]
_PERF_F = ["mean_p95_latency", "max_p95_latency", "mean_error_rate", "mean_throughput", "mean_sla_compliance"]
_STAB_F = ["mean_scaling_events", "mean_volatility", "max_volatility"]


def _by_strategy(aggs: str) -> str:
    return f"SELECT strategy, {aggs} FROM ({_SUMMARY_SQL}) s WHERE status = 'success' GROUP BY strategy"


@register("cost_by_strategy", adapters=["strategy_samples"], floats=_COST_F, sql=_by_strategy(_COST))
def cost_by_strategy(spark, sf):
    """L-7."""
    return st.cost_by_strategy(_summary(spark, sf))


@register("savings", adapters=["strategy_samples"],
          floats=["cpu_savings_percent", "memory_savings_percent", "overall_savings_percent"], sql=f"""
    WITH c AS ({_by_strategy(_COST)}),
    o AS (SELECT max(CASE WHEN strategy = 'statistical' THEN mean_cpu_hours END) AS b_cpu,
                 max(CASE WHEN strategy = 'predictive' THEN mean_cpu_hours END) AS c_cpu,
                 max(CASE WHEN strategy = 'statistical' THEN mean_memory_hours END) AS b_mem,
                 max(CASE WHEN strategy = 'predictive' THEN mean_memory_hours END) AS c_mem FROM c)
    SELECT 'statistical' AS baseline, 'predictive' AS candidate,
           CASE WHEN b_cpu > 0 THEN (b_cpu - c_cpu) / b_cpu * 100 ELSE 0.0 END AS cpu_savings_percent,
           CASE WHEN b_mem > 0 THEN (b_mem - c_mem) / b_mem * 100 ELSE 0.0 END AS memory_savings_percent,
           ((CASE WHEN b_cpu > 0 THEN (b_cpu - c_cpu) / b_cpu * 100 ELSE 0.0 END)
            + (CASE WHEN b_mem > 0 THEN (b_mem - c_mem) / b_mem * 100 ELSE 0.0 END)) / 2.0 AS overall_savings_percent
    FROM o WHERE b_cpu IS NOT NULL AND c_cpu IS NOT NULL""")
def savings(spark, sf):
    """L-8: predictive vs statistical savings."""
    return st.savings(st.cost_by_strategy(_summary(spark, sf)))


@register("performance_by_strategy", adapters=["strategy_samples"], floats=_PERF_F, sql=_by_strategy(_PERF))
def performance_by_strategy(spark, sf):
    """L-9."""
    return st.performance_by_strategy(_summary(spark, sf))


@register("stability_by_strategy", adapters=["strategy_samples"], floats=_STAB_F, sql=_by_strategy(_STAB))
def stability_by_strategy(spark, sf):
    """L-10."""
    return st.stability_by_strategy(_summary(spark, sf))


@register("strategy_report", adapters=["strategy_samples"], floats=_COST_F + _PERF_F + _STAB_F,
          sql=_by_strategy(f"{_COST}, {_PERF}, {_STAB}"))
def strategy_report(spark, sf):
    """L-11: the three analyses side by side."""
    return st.strategy_report(_summary(spark, sf))
