"""Registered queries: resource quantities (Q-1..Q-4) and rightsizing (R-1..R-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantities as qf
from ..operators import rightsize as rz
from ..sources import adapters as ad
from . import sqlfn as S
from .registry import register

_CPU = "metric = 'cpu_cores' AND value IS NOT NULL"
_MEM = "metric = 'mem_bytes' AND value IS NOT NULL"


@register("parse_cpu", adapters=["containers"], floats=["cpu_cores"], sql=f"""
    SELECT container, cpu_request, {S.parse_cpu('cpu_request')} AS cpu_cores FROM containers""")
def parse_cpu(spark, sf):
    """Q-1 on every container request text."""
    c = ad.containers(spark, sf)
    return c.select("container", "cpu_request", qf.parse_cpu("cpu_request").alias("cpu_cores"))


@register("parse_memory", adapters=["containers"], sql=f"""
    SELECT container, memory_request, {S.parse_memory('memory_request')} AS memory_bytes FROM containers""")
def parse_memory(spark, sf):
    """Q-2 on every container request text."""
    c = ad.containers(spark, sf)
    return c.select("container", "memory_request", qf.parse_memory("memory_request").alias("memory_bytes"))


@register("format_cpu", adapters=["samples"], sql=f"""
    SELECT seq, pod, {S.format_cpu('value * 40')} AS cpu_text FROM samples WHERE metric = 'cpu_cores'""")
def format_cpu(spark, sf):
    """Q-3 on every cpu sample (scaled x40 so both branches, < 1 core and >= 1, occur)."""
    s = ad.samples(spark, sf).where(F.col("metric") == "cpu_cores")
    return s.select("seq", "pod", qf.format_cpu(F.col("value") * 40).alias("cpu_text"))


@register("format_memory", adapters=["samples"], sql=f"""
    SELECT seq, pod, {S.format_memory('value * (seq % 40) / 4')} AS memory_text
    FROM samples WHERE metric = 'mem_bytes'""")
def format_memory(spark, sf):
    """Q-4 on every memory sample, scaled so bytes, Ki, Mi and Gi all occur."""
    s = ad.samples(spark, sf).where(F.col("metric") == "mem_bytes")
    return s.select("seq", "pod", qf.format_memory(F.col("value") * (F.col("seq") % 40) / 4).alias("memory_text"))


@register("usage_profile_cpu", adapters=["samples"],
          floats=["percentile_value", "mean", "median", "std", '"min"', '"max"'], sql=f"""
    SELECT service, quantile_cont(value, 0.95) AS percentile_value, avg(value) AS mean,
           quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
           min(value) AS "min", max(value) AS "max", count(value) AS "count"
    FROM samples WHERE {_CPU} GROUP BY service""")
def usage_profile_cpu(spark, sf):
    """R-1: exact p95 and statistics of cpu usage per service."""
    s = ad.samples(spark, sf).where(F.col("metric") == "cpu_cores")
    return rz.usage_profile_cpu(s)


@register("usage_profile_cpu_bounded", adapters=["samples"],
          floats=["percentile_value", "mean", "median", "std", '"min"', '"max"'], sql=f"""
    SELECT service, quantile_cont(value, 0.95) AS percentile_value, avg(value) AS mean,
           quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
           min(value) AS "min", max(value) AS "max", count(value) AS "count"
    FROM samples WHERE {_CPU} GROUP BY service""")
def usage_profile_cpu_bounded(spark, sf):
    """R-1 with the bounded-memory exact quantile (same values as R-1)."""
    s = ad.samples(spark, sf).where(F.col("metric") == "cpu_cores")
    return rz.usage_profile_cpu(s, mode="bounded")


@register("usage_profile_cpu_pod", adapters=["samples"],
          floats=["percentile_value", "mean", "median", "std", '"min"', '"max"'], sql=f"""
    SELECT service, pod, quantile_cont(value, 0.95) AS percentile_value, avg(value) AS mean,
           quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
           min(value) AS "min", max(value) AS "max", count(value) AS "count"
    FROM samples WHERE {_CPU} GROUP BY service, pod""")
def usage_profile_cpu_pod(spark, sf):
    """R-1 at pod grain (many groups)."""
    s = ad.samples(spark, sf).where(F.col("metric") == "cpu_cores")
    return rz.usage_profile_cpu(s, keys=("service", "pod"))


@register("recommend_cpu", adapters=["samples", "containers"], floats=["percentile_value", "recommended_cores"],
          sql=f"""
    SELECT s.service, coalesce(p.pv, 0.0) AS percentile_value,
           greatest(coalesce(p.pv, 0.0), 0.1) AS recommended_cores,
           {S.format_cpu('greatest(coalesce(p.pv, 0.0), 0.1)')} AS recommended_cpu,
           p.n IS NOT NULL AS has_data
    FROM (SELECT DISTINCT service FROM containers) s
    LEFT JOIN (SELECT service, quantile_cont(value, 0.95) AS pv, count(value) AS n
               FROM samples WHERE {_CPU} GROUP BY service) p ON s.service = p.service""")
def recommend_cpu(spark, sf):
    """R-2: max(p95, 0.1) per inventory service, formatted."""
    s = ad.samples(spark, sf).where(F.col("metric") == "cpu_cores")
    return rz.recommend_cpu(ad.containers(spark, sf), s)


@register("usage_profile_memory", adapters=["samples"],
          floats=["max_usage_bytes", "mean", "median", "std", '"min"'], sql=f"""
    SELECT service, max(value) AS max_usage_bytes, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
           stddev_samp(value) AS std, min(value) AS "min", count(value) AS "count"
    FROM samples WHERE {_MEM} GROUP BY service""")
def usage_profile_memory(spark, sf):
    """R-3: max and statistics of memory usage per service."""
    s = ad.samples(spark, sf).where(F.col("metric") == "mem_bytes")
    return rz.usage_profile_memory(s)


_REC_MEM = "greatest(CAST(trunc(coalesce(p.mx, 0.0) * 1.15) AS BIGINT), 134217728)"


@register("recommend_memory", adapters=["samples", "containers"], floats=["max_usage_bytes"], sql=f"""
    SELECT s.service, coalesce(p.mx, 0.0) AS max_usage_bytes, {_REC_MEM} AS recommended_bytes,
           {S.format_memory(_REC_MEM)} AS recommended_memory, p.n IS NOT NULL AS has_data
    FROM (SELECT DISTINCT service FROM containers) s
    LEFT JOIN (SELECT service, max(value) AS mx, count(value) AS n FROM samples WHERE {_MEM}
               GROUP BY service) p ON s.service = p.service""")
def recommend_memory(spark, sf):
    """R-4: int(max * 1.15) with a 128 Mi floor per inventory service."""
    s = ad.samples(spark, sf).where(F.col("metric") == "mem_bytes")
    return rz.recommend_memory(ad.containers(spark, sf), s)


_PROFILE_SQL = f"""
    SELECT service,
           quantile_cont(value, 0.95) FILTER (WHERE metric = 'cpu_cores') AS pv,
           count(value) FILTER (WHERE metric = 'cpu_cores') AS cn,
           max(value) FILTER (WHERE metric = 'mem_bytes') AS mx,
           count(value) FILTER (WHERE metric = 'mem_bytes') AS mn
    FROM samples WHERE metric IN ('cpu_cores', 'mem_bytes') AND value IS NOT NULL GROUP BY service"""

_REC_SQL = f"""
    SELECT c.service, c.namespace, c.container, 'statistical' AS strategy,
           c.cpu_request AS current_cpu, c.memory_request AS current_memory,
           {S.format_cpu('greatest(coalesce(p.pv, 0.0), 0.1)')} AS recommended_cpu,
           {S.format_memory(_REC_MEM)} AS recommended_memory,
           coalesce(p.pv, 0.0) AS cpu_percentile_value, coalesce(p.mx, 0.0) AS mem_max_usage_bytes,
           coalesce(p.cn, 0) > 0 AS cpu_has_data, coalesce(p.mn, 0) > 0 AS mem_has_data,
           95.0::DOUBLE AS cpu_percentile, 15.0::DOUBLE AS memory_buffer_percentage
    FROM containers c LEFT JOIN ({_PROFILE_SQL}) p ON c.service = p.service"""


@register("recommendations", adapters=["samples", "containers"],
          floats=["cpu_percentile_value", "mem_max_usage_bytes", "cpu_percentile", "memory_buffer_percentage"],
          sql=_REC_SQL)
def recommendations(spark, sf):
    """R-5: one row per container, current vs recommended (the flagship)."""
    return rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf))


@register("recommendations_bounded", adapters=["samples", "containers"],
          floats=["cpu_percentile_value", "mem_max_usage_bytes", "cpu_percentile", "memory_buffer_percentage"],
          sql=_REC_SQL)
def recommendations_bounded(spark, sf):
    """R-5 with the bounded-memory exact p95 (same result as R-5)."""
    return rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf), mode="bounded")


_VAL_CPU = S.parse_cpu("recommended_cpu")
_VAL_MEM = S.parse_memory("recommended_memory")


_WARN = f"""array_to_string(list_filter([
             CASE WHEN {_VAL_CPU} < 0.01 THEN 'Very low CPU recommendation for ' || container || ': ' || {_VAL_CPU}
                  WHEN {_VAL_CPU} > 8.0 THEN 'High CPU recommendation for ' || container || ': ' || {_VAL_CPU} || ' cores' END,
             CASE WHEN {_VAL_MEM} < 33554432 THEN 'Very low memory recommendation for ' || container || ': ' || recommended_memory
                  WHEN {_VAL_MEM} > 34359738368 THEN 'Very high memory recommendation for ' || container || ': ' || recommended_memory END],
             lambda x: x IS NOT NULL), '; ')"""


@register("validate_recommendations", adapters=["samples", "containers"], floats=["recommended_cores"], sql=f"""
    SELECT service, container, recommended_cpu, recommended_memory,
           {_VAL_CPU} AS recommended_cores, {_VAL_MEM} AS recommended_bytes,
           {_WARN} AS warnings,
           CASE WHEN {_VAL_CPU} < 0.01 THEN 'low_cpu' WHEN {_VAL_CPU} > 8.0 THEN 'high_cpu' END AS cpu_flag,
           CASE WHEN {_VAL_MEM} < 33554432 THEN 'low_memory'
                WHEN {_VAL_MEM} > 34359738368 THEN 'high_memory' END AS memory_flag
    FROM ({_REC_SQL}) r""")
def validate_recommendations(spark, sf):
    """R-6: warnings from the formatted recommendations."""
    v = rz.validate_recommendations(rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf)))
    return v.withColumn("warnings", F.array_join("warnings", "; "))


@register("validation_summary", adapters=["samples", "containers"], sql=f"""
    SELECT true AS is_valid, CAST(sum(CAST(({_VAL_CPU} < 0.01 OR {_VAL_CPU} > 8.0) AS INTEGER)
             + CAST(({_VAL_MEM} < 33554432 OR {_VAL_MEM} > 34359738368) AS INTEGER)) AS BIGINT) AS n_warnings,
           count(*) AS n_recommendations
    FROM ({_REC_SQL}) r""")
def validation_summary(spark, sf):
    """R-6: overall verdict and number of warnings."""
    return rz.validation_summary(rz.validate_recommendations(rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf))))


@register("recommendations_nested", adapters=["samples", "containers"], floats=["percentile_value"], sql=f"""
    SELECT service, namespace, container, strategy, 95.0::DOUBLE AS cpu_percentile, current_cpu, recommended_memory,
           cpu_percentile_value AS percentile_value, mem_has_data FROM ({_REC_SQL}) r""")
def recommendations_nested(spark, sf):
    """R-5, the nested view, with fields of each of its structs."""
    n = rz.recommendations_nested(rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf)))
    return n.select("service", "namespace", "container", "strategy", "parameters.cpu_percentile",
                    F.col("current_requests.cpu").alias("current_cpu"), F.col("recommended_requests.memory").alias("recommended_memory"),
                    F.col("analysis.cpu.percentile_value").alias("percentile_value"), F.col("analysis.memory.has_data").alias("mem_has_data"))


@register("resource_delta", adapters=["samples", "containers"],
          floats=["current_value", "recommended_value", "change"], sql=f"""
    SELECT service, container, 'cpu' AS resource, current_cpu AS current, recommended_cpu AS recommended,
           {S.parse_cpu('current_cpu')} AS current_value, {S.parse_cpu('recommended_cpu')} AS recommended_value,
           {S.parse_cpu('recommended_cpu')} - {S.parse_cpu('current_cpu')} AS change
    FROM ({_REC_SQL}) r
    UNION ALL
    SELECT service, container, 'memory', current_memory, recommended_memory,
           CAST({S.parse_memory('current_memory')} AS DOUBLE), CAST({S.parse_memory('recommended_memory')} AS DOUBLE),
           CAST({S.parse_memory('recommended_memory')} AS DOUBLE) - CAST({S.parse_memory('current_memory')} AS DOUBLE)
    FROM ({_REC_SQL}) r""")
def resource_delta(spark, sf):
    """R-7: current vs recommended per (container, resource)."""
    return rz.resource_delta(rz.recommendations(ad.containers(spark, sf), ad.samples(spark, sf)))
