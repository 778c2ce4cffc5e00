"""The adapters of :mod:`capstan.sources.adapters`, written as DuckDB CTEs.

Only used to build oracle SQL for the correctness gate; never executed by the
library itself.
"""

from __future__ import annotations

_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _raw_sql() -> str:
    from ..sources.adapters import RAW_METRICS

    parts = []
    for m, node, up, x in RAW_METRICS:
        service = "'node'" if node else "event_type"
        expr = x.replace("v", "value")
        if up:
            expr = (f"sum(CAST({expr} AS DOUBLE)) OVER (PARTITION BY {service}, user_id % 4, CAST(ts AS DATE) ORDER BY ts, event_id "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        parts.append(f"SELECT '{m}' AS metric, {service} AS service, 'node-' || (user_id % 4) AS instance, ts, event_id AS seq, "
                     f"CAST({expr} AS DOUBLE) AS value FROM ev")
    return " UNION ALL ".join(parts)


# name -> (dependencies, body)
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"SELECT *, {_K} AS k FROM events"),
    "samples": (("ev",), """
        SELECT 'cpu_cores' AS metric, event_type AS service, 'default' AS namespace,
               'pod-' || user_id AS pod, 'app' AS container, 'node-' || (user_id % 4) AS instance,
               ts, event_id AS seq, CAST(value / 1000.0 AS DOUBLE) AS value FROM ev
        UNION ALL
        SELECT 'mem_bytes', event_type, 'default', 'pod-' || user_id, 'app', 'node-' || (user_id % 4),
               ts, event_id, CAST(64 + k AS DOUBLE) * 1048576 FROM ev"""),
    "counters": ((), """
        SELECT 'requests_total' AS metric, event_type AS service, ts, event_id AS seq,
               sum(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
        FROM events"""),
    "paired_h": (("ev",), """
        SELECT event_type AS instance, date_trunc('hour', ts) AS ts,
               CAST(sum(k) AS DOUBLE) AS avail, sum(value) AS v
        FROM ev GROUP BY 1, 2"""),
    "paired": (("paired_h",), """
        SELECT instance, ts, 'mem_available' AS metric, avail AS value FROM paired_h
        UNION ALL SELECT instance, ts, 'mem_total', avail + v FROM paired_h"""),
    "http": ((), """
        SELECT 'svc-' || (user_id % 5) AS service, ts, event_id AS seq,
               CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS "timeStamp",
               CAST(floor(value) AS BIGINT) AS elapsed, event_type AS label,
               CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
               event_type <> 'error' AS success, CAST(value / 1000.0 AS DOUBLE) AS latency_s
        FROM events"""),
    "buckets_d": ((), """
        SELECT event_type AS service, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
               count_if(value / 1000.0 <= 0.01) AS b0, count_if(value / 1000.0 <= 0.025) AS b1,
               count_if(value / 1000.0 <= 0.05) AS b2, count_if(value / 1000.0 <= 0.1) AS b3,
               count_if(value / 1000.0 <= 0.25) AS b4, count_if(value / 1000.0 <= 0.5) AS b5,
               count(*) AS b6
        FROM events GROUP BY 1, 2"""),
    "buckets": (("buckets_d",), """
        SELECT service, ts, 0.01::DOUBLE AS le, b0::BIGINT AS cumulative FROM buckets_d
        UNION ALL SELECT service, ts, 0.025::DOUBLE, b1::BIGINT FROM buckets_d
        UNION ALL SELECT service, ts, 0.05::DOUBLE, b2::BIGINT FROM buckets_d
        UNION ALL SELECT service, ts, 0.1::DOUBLE, b3::BIGINT FROM buckets_d
        UNION ALL SELECT service, ts, 0.25::DOUBLE, b4::BIGINT FROM buckets_d
        UNION ALL SELECT service, ts, 0.5::DOUBLE, b5::BIGINT FROM buckets_d
        UNION ALL SELECT service, ts, 'inf'::DOUBLE, b6::BIGINT FROM buckets_d"""),
    "experiments_b": (("ev",), """
        SELECT event_id, ts, event_type AS service,
               ['browsing', 'checkout'][user_id % 2 + 1] AS scenario,
               CAST([1, 2, 4][(user_id // 2) % 3 + 1] AS INTEGER) AS replica_count,
               CAST([5, 10, 20, 30, 50, 75][(user_id // 6) % 6 + 1] AS INTEGER) AS load_users,
               CAST(value / 1000.0 AS DOUBLE) AS cpu_cores_value,
               CAST(64 + k AS DOUBLE) * 1048576 AS mem_bytes_value,
               CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(k AS DOUBLE) * 1024 END AS net_rx_bytes_value,
               CASE WHEN event_type = 'signup' THEN NULL ELSE value * 512 END AS net_tx_bytes_value,
               CAST(floor(k / 25) AS DOUBLE) AS pod_restarts_value,
               CAST([1, 2, 4][(user_id // 2) % 3 + 1] AS DOUBLE) AS replica_count_value,
               CAST(k AS DOUBLE) AS node_cpu_util_value,
               CAST(50 + value / 10.0 AS DOUBLE) AS node_mem_util_value
        FROM ev"""),
    "experiments": (("experiments_b",), """
        SELECT *, 't_' || idx AS "timestamp" FROM (
          SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ts, event_id) - 1 AS idx
          FROM (SELECT *, service || '_' || scenario || '_replicas_' || replica_count
                          || '_users_' || load_users AS experiment_id FROM experiments_b) e) x"""),
    "gappy": (("experiments",), """
        SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE cpu_cores_value END AS cpu_cores_value)
        FROM experiments"""),
    "containers": ((), """
        SELECT ['click', 'error', 'purchase', 'signup', 'view'][p_partkey % 5 + 1] AS service,
               'default' AS namespace, 'c-' || p_partkey AS container,
               CASE p_partkey % 6 WHEN 0 THEN (p_size * 10) || 'm' WHEN 1 THEN CAST(p_size AS VARCHAR)
                    WHEN 2 THEN 'Unknown' WHEN 3 THEN (p_size * 100) || 'm'
                    WHEN 4 THEN (p_size // 10) || '.' || (p_size % 10) ELSE '' END AS cpu_request,
               CASE p_partkey % 6 WHEN 0 THEN (p_size * 16) || 'Mi' WHEN 1 THEN (p_size * 16 * 1024) || 'Ki'
                    WHEN 2 THEN (p_size // 10) || '.' || (p_size % 10) || 'Gi' WHEN 3 THEN (p_size * 16) || 'M'
                    WHEN 4 THEN CAST(CAST(p_size AS BIGINT) * 16 * 1048576 AS VARCHAR) ELSE '' END AS memory_request
        FROM part"""),
    "pred_o": ((), """
        SELECT 'svc-' || (o_custkey % 5) AS service,
               CASE o_orderstatus WHEN 'F' THEN 'cpu_target' WHEN 'O' THEN 'memory_target'
                    ELSE 'replica_target' END AS target,
               o_orderkey AS idx, o_totalprice AS y_true,
               CAST(substr(o_orderpriority, 1, 1) IN ('1', '2') AS INTEGER) AS label,
               CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS proba, o_orderkey, o_custkey
        FROM orders"""),
    "predictions": (("pred_o",), """
        SELECT service, target, 'forest' AS model, idx, y_true,
               y_true * (1 + CAST((o_orderkey % 7) - 3 AS DOUBLE) / 100) AS y_pred, label, proba FROM pred_o
        UNION ALL SELECT service, target, 'boosted', idx, y_true, y_true * 0.9 + 1000, label, proba FROM pred_o
        UNION ALL SELECT service, target, 'seasonal', idx, y_true,
               y_true + CAST((o_custkey % 11) - 5 AS DOUBLE) * 100, label, proba FROM pred_o"""),
    "strategy_samples": (("ev",), """
        SELECT 'exp-' || user_id AS experiment_id,
               ['frontend', 'cartservice', 'checkoutservice'][user_id % 3 + 1] AS service_name,
               ['statistical', 'predictive', 'hpa', 'statistical'][user_id % 4 + 1] AS strategy,
               CASE WHEN user_id % 4 = 3 THEN 'failed' ELSE 'success' END AS status,
               ts, event_id AS seq, CAST(value / 100.0 AS DOUBLE) AS cpu_cores,
               CAST(64 + k AS DOUBLE) / 64 AS memory_gb,
               CAST(k % 3 + 1 AS INTEGER) AS replica_count,
               CAST(1.0 / 120.0 AS DOUBLE) AS elapsed_hours,
               CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value / 1000.0 END AS p95_latency,
               CAST(value / 2000.0 AS DOUBLE) AS avg_response_time,
               CAST(k AS DOUBLE) / 1000 AS error_rate, value AS throughput,
               CAST(value / 500.0 AS DOUBLE) AS cpu_utilization
        FROM ev"""),
    "model_results": (("predictions",), """
        SELECT service, target, model,
               CASE WHEN service = 'svc-3' OR service = 'svc-4' AND target = 'replica_target' THEN 'failed'
                    ELSE 'success' END AS status,
               CASE target WHEN 'cpu_target' THEN m * 1e-7 WHEN 'memory_target' THEN m * 1e7 ELSE m * 5e-6 END AS mse,
               CASE target WHEN 'cpu_target' THEN a * 2e-4 WHEN 'memory_target' THEN a * 3.3e5 ELSE a * 1e-3 END AS mae,
               CASE target WHEN 'cpu_target' THEN 1 - m / 1.4e5 WHEN 'memory_target' THEN -5 * m / 1e5
                    ELSE 1 - m / 1.6e5 END AS r2,
               CASE WHEN m / 333.0 > 0 THEN least(0.9, greatest(0.5, 1.0 - m / 333.0 / 1000.0)) ELSE 0.7 END
                 AS confidence
        FROM (SELECT service, target, model, avg((y_pred - y_true) * (y_pred - y_true)) AS m,
                     avg(abs(y_pred - y_true)) AS a
              FROM predictions GROUP BY service, target, model) g"""),
    "records": (("experiments",), """
        SELECT *, CASE WHEN load_users = 75 AND scenario = 'checkout' THEN 'failed'
                       WHEN load_users = 5 AND replica_count = 4 THEN 'skipped'
                       WHEN replica_count = 4 THEN 'completed_with_warnings' ELSE 'completed' END AS status
        FROM (SELECT DISTINCT experiment_id, service AS target_service, scenario, replica_count, load_users
              FROM experiments) r"""),
    "deployments": ((), """
        SELECT service || '-' || shard AS name, service, CAST(count(*) AS INTEGER) AS replicas,
               CAST(count(*) FILTER (WHERE p_size > 5) AS INTEGER) AS ready_replicas,
               count(DISTINCT p_partkey) AS n_containers,
               array_to_string(list_sort(list('c-' || p_partkey)), ',') AS containers
        FROM (SELECT ['click', 'error', 'purchase', 'signup', 'view'][p_partkey % 5 + 1] AS service,
                     p_partkey % 40 AS shard, p_partkey, p_size FROM part) p
        GROUP BY 1, 2"""),
    "http_counters": ((), """
        SELECT metric, service, status, ts, seq,
               CAST(count(*) OVER (PARTITION BY metric, service, status, CAST(ts AS DATE) ORDER BY ts, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
        FROM (SELECT unnest(CASE user_id % 5 WHEN 0 THEN ['ingress_requests', 'http_requests'] WHEN 1 THEN ['mesh_requests']
                            ELSE ['http_requests'] END) AS metric, 'svc-' || (user_id % 5) AS service,
                     CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, ts, event_id AS seq FROM events) e"""),
    "raw_metrics": (("ev",), _raw_sql()),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in ADAPTERS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_adapters(body: str, names) -> str:
    names = _order(names)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n][1]}\n)" for n in names)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
