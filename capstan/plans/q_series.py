"""Registered queries: metric-series operators (B-1..B-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as se
from ..sources import adapters as ad
from .registry import register

RANGE_S = 6 * 3600          # counter rate range
STEP_S = 3600               # evaluation step
LOOKBACK_S = 2 * 3600       # staleness look-back
GRID_START, GRID_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def _rate_sql(src: str, range_s: int = RANGE_S, series: str = "service") -> str:
    return f"""
    SELECT * EXCLUDE (inc, t, n) FROM (
      SELECT *, (sum(inc) OVER f - coalesce(first_value(inc) OVER f, 0.0)) / {float(range_s)} AS rate,
             count(*) OVER f AS n
      FROM (SELECT *, epoch_us(ts) AS t,
                   CASE WHEN lag(value) OVER w IS NULL THEN NULL WHEN value < lag(value) OVER w THEN value
                        ELSE value - lag(value) OVER w END AS inc
            FROM {src} WINDOW w AS (PARTITION BY {series} ORDER BY ts, seq)) c
      WINDOW f AS (PARTITION BY {series} ORDER BY t RANGE BETWEEN {range_s * 1000000 - 1} PRECEDING AND CURRENT ROW)
    ) r WHERE n >= 2"""


@register("select_series", adapters=["samples"], floats=["value"], sql="""
    SELECT metric, service, pod, instance, ts, seq, value FROM samples
    WHERE metric = 'cpu_cores' AND regexp_full_match(pod, 'pod-1.*') AND service <> 'error'
      AND NOT regexp_full_match(instance, 'node-[23]')""")
def select_series(spark, sf):
    """B-1: all four label matchers on the samples."""
    s = ad.samples(spark, sf)
    out = se.select_series(s, eq={"metric": "cpu_cores"}, re={"pod": "pod-1.*"}, ne={"service": "error"},
                           nre={"instance": "node-[23]"})
    return out.select("metric", "service", "pod", "instance", "ts", "seq", "value")


@register("rate", adapters=["counters"], floats=["value", "rate"], sql=_rate_sql("counters"))
def rate(spark, sf):
    """B-2: 6 h counter rate with daily resets, at every sample."""
    return se.rate(ad.counters(spark, sf), RANGE_S)


@register("agg_by", adapters=["samples"], floats=["value"], sql="""
    SELECT date_trunc('hour', ts) AS ts, metric, instance, avg(value) AS value
    FROM samples GROUP BY 1, 2, 3""")
def agg_by(spark, sf):
    """B-3: avg by (metric, instance) at each (hour-aligned) timestamp."""
    s = ad.samples(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return se.agg_by(s, "avg", by=("metric", "instance"))


@register("vector_binary", adapters=["paired"], floats=["value"], sql="""
    SELECT t.ts, t.instance, t.value - a.value AS value
    FROM paired t JOIN paired a ON t.ts = a.ts AND t.instance = a.instance
    WHERE t.metric = 'mem_total' AND a.metric = 'mem_available'""")
def vector_binary(spark, sf):
    """B-4: total - available, label-matched on (ts, instance)."""
    p = ad.paired(spark, sf)
    return se.vector_binary(p.where(F.col("metric") == "mem_total"), p.where(F.col("metric") == "mem_available"),
                            ["ts", "instance"], "-")


def _idle(spark, sf):
    c = ad.counters(spark, sf)
    return c.select(F.col("service").alias("instance"), "ts", "seq", (F.col("value") / 1e6).alias("value"))


@register("node_cpu_utilization", adapters=["counters"], floats=["cpu_utilization"], sql=f"""
    WITH idle AS (SELECT service AS instance, ts, seq, value / 1e6 AS value FROM counters)
    SELECT ts, instance, 100 - avg(rate) * 100 AS cpu_utilization
    FROM ({_rate_sql('idle', series='instance')}) r GROUP BY ts, instance""")
def node_cpu_utilization(spark, sf):
    """B-5: 100 - avg by (instance) (rate(idle)) * 100."""
    return se.node_cpu_utilization(_idle(spark, sf), RANGE_S)


@register("node_memory_utilization", adapters=["paired"], floats=["memory_utilization"], sql="""
    SELECT a.ts, a.instance,
           (1 - CASE WHEN t.value = 0 THEN NULL ELSE a.value / t.value END) * 100 AS memory_utilization
    FROM paired a JOIN paired t ON a.ts = t.ts AND a.instance = t.instance
    WHERE a.metric = 'mem_available' AND t.metric = 'mem_total'""")
def node_memory_utilization(spark, sf):
    """B-6: (1 - available / total) * 100."""
    return se.node_memory_utilization(ad.paired(spark, sf))


def _hq_sql(src: str, q: float, keys: str = "service, ts") -> str:
    return f"""
    SELECT {keys},
           CASE WHEN total = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN maxfin
                WHEN cumulative = coalesce(cprev, 0) THEN le
                ELSE coalesce(lo, 0.0) + (le - coalesce(lo, 0.0)) * (total * {q} - coalesce(cprev, 0))
                     / (cumulative - coalesce(cprev, 0)) END AS quantile
    FROM (SELECT *, lag(le) OVER w AS lo, lag(cumulative) OVER w AS cprev,
                 max(cumulative) OVER p AS total,
                 max(CASE WHEN le <> 'inf'::DOUBLE THEN le END) OVER p AS maxfin
          FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY le), p AS (PARTITION BY {keys})) b
    WHERE cumulative >= total * {q}
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY le) = 1"""


@register("histogram_quantile", adapters=["buckets"], floats=["quantile"], sql=_hq_sql("buckets", 0.95))
def histogram_quantile(spark, sf):
    """B-7: p95 of the daily latency histograms."""
    return se.histogram_quantile(ad.buckets(spark, sf), 0.95)


def _at_sql(src: str, series: str, extra: str = "") -> str:
    """Latest sample of each series on the step grid, not older than the range."""
    keys = ", ".join(f"g.{c}" for c in series.split(", "))
    same = " AND ".join(f"c.{c} = g.{c}" for c in series.split(", "))
    return f"""
    SELECT {keys}, g.ts, arg_max(c.value, (c.ts, c.seq)) AS value
    FROM (SELECT {series}, unnest(generate_series(TIMESTAMP '{GRID_START}', TIMESTAMP '{GRID_END}', INTERVAL {STEP_S} SECOND)) AS ts
          FROM (SELECT DISTINCT {series} FROM {src}) s) g
    JOIN {src} c ON {same} AND c.ts <= g.ts AND c.ts > g.ts - INTERVAL {RANGE_S} SECOND
    GROUP BY {keys}, g.ts"""


_HTTP = "metric, service, status"
_HTTP_RATES = f"""
    r AS (SELECT metric, service, status, ts, seq, rate AS value FROM ({_rate_sql('http_counters', series=_HTTP)}) x),
    g AS ({_at_sql('r', _HTTP)})"""


@register("error_ratio", adapters=["http_counters"], floats=["error_ratio"], sql=f"""
    WITH {_HTTP_RATES}
    SELECT metric, service, ts, CASE WHEN sum(value) = 0 THEN NULL
             ELSE sum(value) FILTER (WHERE status LIKE '5%') / sum(value) END AS error_ratio
    FROM g GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE status LIKE '5%') > 0""")
def error_ratio(spark, sf):
    """B-8: rate of 5xx over rate of all, trailing 6 h, hourly, per source and service."""
    return se.error_ratio(ad.http_counters(spark, sf), GRID_START, GRID_END, STEP_S, RANGE_S, by=("metric", "service"))


@register("requests_per_second", adapters=["http_counters"], floats=["requests_per_second"], sql=f"""
    WITH {_HTTP_RATES},
    u AS (SELECT service, ts, sum(value) AS requests_per_second,
                 list_position({ad.HTTP_SOURCES}, metric) - 1 AS priority
          FROM g WHERE status NOT LIKE '5%' GROUP BY metric, service, ts)
    SELECT * FROM u WHERE priority = (SELECT min(priority) FROM u u2 WHERE u2.service = u.service)""")
def requests_per_second(spark, sf):
    """B-9 (+ B-13): non-5xx rate over the trailing 6 h, hourly, from the first
    source that a service has."""
    return se.requests_per_second(ad.http_counters(spark, sf), GRID_START, GRID_END, STEP_S, RANGE_S, ad.HTTP_SOURCES)


@register("cpu_throttled_rate", adapters=["counters"], floats=["value", "rate"], sql=f"""
    WITH secs AS (SELECT * FROM counters WHERE service IN ('click', 'view')),
    periods AS (SELECT metric, service, ts, seq, value * 2 AS value FROM counters),
    u AS (SELECT *, 0 AS priority FROM ({_rate_sql('secs')}) a
          UNION ALL SELECT *, 1 AS priority FROM ({_rate_sql('periods')}) b)
    SELECT * FROM u WHERE priority = (SELECT min(priority) FROM u u2 WHERE u2.service = u.service)""")
def cpu_throttled_rate(spark, sf):
    """B-10 (+ B-13): throttled seconds where present, else periods."""
    c = ad.counters(spark, sf)
    secs = c.where(F.col("service").isin("click", "view"))
    periods = c.withColumn("value", F.col("value") * 2)
    return se.cpu_throttled_rate(secs, periods, RANGE_S)


@register("range_eval", adapters=["counters"], floats=["value"], sql=f"""
    WITH g AS (SELECT s.service, unnest(generate_series(TIMESTAMP '{GRID_START}', TIMESTAMP '{GRID_END}',
                                                        INTERVAL {STEP_S} SECOND)) AS ts
               FROM (SELECT DISTINCT service FROM counters) s)
    SELECT g.service, g.ts, arg_max(c.value, (c.ts, c.seq)) AS value
    FROM g JOIN counters c ON c.service = g.service AND c.ts <= g.ts
                          AND c.ts > g.ts - INTERVAL {LOOKBACK_S} SECOND
    GROUP BY g.service, g.ts""")
def range_eval(spark, sf):
    """B-11: counters on an hourly grid over the whole month, 2 h staleness."""
    return se.range_eval(ad.counters(spark, sf), GRID_START, GRID_END, STEP_S, LOOKBACK_S)


@register("time_range", adapters=["samples"], floats=["value"], sql="""
    SELECT metric, service, pod, ts, seq, value FROM samples
    WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00'""")
def time_range(spark, sf):
    """B-12: the 6 hours ending at a fixed instant."""
    s = ad.samples(spark, sf)
    return se.time_range(s, "2024-01-15 12:00:00", 6 * 3600).select("metric", "service", "pod", "ts", "seq", "value")


@register("first_available", adapters=["samples"], floats=["value"], sql="""
    WITH u AS (SELECT metric, service, seq, value, 0 AS priority FROM samples
               WHERE metric = 'net_rx_bytes'
               UNION ALL SELECT metric, service, seq, value, 1 FROM samples
               WHERE metric = 'mem_bytes' AND service IN ('click', 'error')
               UNION ALL SELECT metric, service, seq, value, 2 FROM samples WHERE metric = 'cpu_cores')
    SELECT * FROM u WHERE priority = (SELECT min(priority) FROM u u2 WHERE u2.service = u.service)""")
def first_available(spark, sf):
    """B-13: network (absent) -> memory (two services) -> cpu fallback."""
    s = ad.samples(spark, sf).select("metric", "service", "seq", "value")
    c0 = s.where(F.col("metric") == "net_rx_bytes")
    c1 = s.where((F.col("metric") == "mem_bytes") & F.col("service").isin("click", "error"))
    c2 = s.where(F.col("metric") == "cpu_cores")
    return se.first_available([c0, c1, c2])


_RAW = "metric, service, instance"


def _raw_grid(rated, plain) -> str:
    rated, plain = (", ".join(f"'{m}'" for m in x) for x in (rated, plain))
    return f"""
    c AS (SELECT * FROM raw_metrics WHERE metric IN ({rated})),
    u AS (SELECT metric, service, instance, ts, seq, rate AS value FROM ({_rate_sql('c', series=_RAW)}) x
          UNION ALL SELECT metric, service, instance, ts, seq, value FROM raw_metrics WHERE metric IN ({plain})),
    g AS ({_at_sql('u', _RAW)})"""


_NAMES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in se.COLLECTED.items())


@register("collected_series", adapters=["raw_metrics"], floats=["value"], sql=f"""
    WITH {_raw_grid([*se.RATED, 'node_idle'], [m for m in se.COLLECTED if m not in se.RATED] + ['mem_available', 'mem_total'])}
    SELECT CASE metric {_NAMES} END AS metric, service AS "key", ts, sum(value) AS value
    FROM g WHERE service <> 'node' GROUP BY metric, service, ts
    UNION ALL SELECT 'node_cpu_util', instance, ts, 100 - value * 100 FROM g WHERE metric = 'node_idle'
    UNION ALL SELECT 'node_mem_util', a.instance, a.ts, (1 - CASE WHEN t.value = 0 THEN NULL ELSE a.value / t.value END) * 100
    FROM g a JOIN g t ON a.instance = t.instance AND a.ts = t.ts AND a.metric = 'mem_available' AND t.metric = 'mem_total'""")
def collected_series(spark, sf):
    """B-14: the eight collected series, hourly, counters rated over 6 h."""
    return se.collected_series(ad.raw_metrics(spark, sf), GRID_START, GRID_END, STEP_S, RANGE_S)


@register("series_panels", adapters=["raw_metrics"], floats=["value"], sql=f"""
    WITH {_raw_grid(se.PANEL_RATES, se.PANEL_VALUES)}
    SELECT metric, service, instance, ts, value FROM g""")
def series_panels(spark, sf):
    """B-15: receive, transmit and file-system rates, pod phase, replicas and
    restarts by series, hourly."""
    return se.series_panels(ad.raw_metrics(spark, sf), GRID_START, GRID_END, STEP_S, RANGE_S)


@register("panel_queries", adapters=["samples"], floats=["avg_value", "sum_value"], sql="""
    WITH s AS (SELECT metric, service, CASE WHEN seq % 11 = 0 THEN NULL ELSE pod END AS pod, container,
                      date_trunc('hour', ts) AS ts, value FROM samples)
    SELECT metric, ts, 'pod' AS "by", pod AS "key", avg(value) AS avg_value, sum(value) AS sum_value FROM s GROUP BY 1, 2, 4
    UNION ALL SELECT metric, ts, 'container', container, avg(value), sum(value) FROM s GROUP BY 1, 2, 4
    UNION ALL SELECT metric, ts, 'service', service, avg(value), sum(value) FROM s GROUP BY 1, 2, 4""")
def panel_queries(spark, sf):
    """B-15: dashboard panels in one grouping-sets aggregate; some samples have no pod."""
    s = ad.samples(spark, sf)
    return se.panel_queries(s.withColumn("pod", F.when(F.col("seq") % 11 != 0, F.col("pod"))))


@register("metric_names", adapters=["samples"], sql="SELECT DISTINCT metric FROM samples")
def metric_names(spark, sf):
    """B-16: names of all metrics."""
    return se.metric_names(ad.samples(spark, sf))


@register("available_metrics", adapters=["samples"], sql="""
    SELECT p.metric, coalesce(c.n, 0) AS n_rows, c.n IS NOT NULL AS available
    FROM (VALUES ('cpu_cores'), ('mem_bytes'), ('net_rx_bytes'), ('pod_restarts')) p(metric)
    LEFT JOIN (SELECT metric, count(*) AS n FROM samples GROUP BY metric) c ON p.metric = c.metric""")
def available_metrics(spark, sf):
    """B-16: which probed metrics have rows."""
    return se.available_metrics(ad.samples(spark, sf), ["cpu_cores", "mem_bytes", "net_rx_bytes", "pod_restarts"])
