"""Explicit schemas of the capacity tables (no inference on the read path)."""

from __future__ import annotations

from pyspark.sql import types as T

D, L, I, S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()
MAP = T.MapType(S, S)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


METRIC_VALUE_COLUMNS = ["cpu_cores_value", "mem_bytes_value", "net_rx_bytes_value", "net_tx_bytes_value",
                        "pod_restarts_value", "replica_count_value", "node_cpu_util_value", "node_mem_util_value",
                        "network_activity_rate_value", "processing_intensity_value", "service_stability_value",
                        "resource_pressure_value"]

EXPERIMENTS_WIDE = _struct(("timestamp", S), ("experiment_id", S), ("service", S), ("scenario", S),
                           ("replica_count", I), ("load_users", I), *[(c, D) for c in METRIC_VALUE_COLUMNS])

FEATURES = T.StructType(EXPERIMENTS_WIDE.fields + _struct(
    ("replica_change", D), ("replica_scaling_up", I), ("load_change", D), ("load_increasing", I),
    ("cpu_regime_encoded", I), ("time_idx", I), ("hour_pattern", D), ("growth_trend", D),
    ("cpu_cores_value_roll_mean", D), ("cpu_cores_value_lag_1", D),
    ("mem_bytes_value_roll_mean", D), ("mem_bytes_value_lag_1", D)).fields)

EXPERIMENT_RECORD = _struct(("experiment_id", S), ("target_service", S), ("replica_count", I), ("load_users", I),
                            ("duration_minutes", I), ("collection_start", T.TimestampType()),
                            ("collection_end", T.TimestampType()), ("status", S))

CONTAINER = _struct(("name", S), ("image", S), ("requests", MAP), ("limits", MAP))
INVENTORY = _struct(("name", S), ("namespace", S), ("replicas", I), ("ready_replicas", I), ("labels", MAP),
                    ("containers", T.ArrayType(CONTAINER)))
CONTAINER_STATUS = _struct(("name", S), ("ready", T.BooleanType()), ("restart_count", I), ("state", S))
PODS = _struct(("name", S), ("namespace", S), ("status", S), ("node_name", S), ("labels", MAP),
               ("containers", T.ArrayType(CONTAINER)), ("statuses", T.ArrayType(CONTAINER_STATUS)))

RANGE_ITEMS = T.ArrayType(_struct(("metric", MAP), ("values", T.ArrayType(T.ArrayType(S)))))
VECTOR_ITEMS = T.ArrayType(_struct(("metric", MAP), ("value", T.ArrayType(S)), ("timestamp", S)))

REQUEST_LOG_COLUMNS = [("timeStamp", "bigint"), ("elapsed", "bigint"), ("label", "string"),
                       ("responseCode", "string"), ("success", "boolean")]

SAMPLES = _struct(("metric", S), ("service", S), ("namespace", S), ("pod", S), ("container", S),
                  ("labels", MAP), ("ts", T.TimestampType()), ("value", D))

_COST = _struct(("total_cpu_hours", D), ("total_memory_hours", D), ("avg_cpu_cores", D), ("avg_memory_gb", D))
_PERF = _struct(("avg_p95_latency", D), ("max_p95_latency", D), ("avg_error_rate", D), ("avg_throughput", D))
_STAB = _struct(("scaling_events", L), ("avg_volatility", D), ("max_volatility", D))
STRATEGY_RESULTS = _struct(
    ("service_name", S),
    ("experiments", T.ArrayType(_struct(
        ("experiment_id", S), ("service_name", S), ("strategy", S), ("status", S),
        ("summary", _struct(("data_points", L), ("cost_efficiency", _COST), ("performance_integrity", _PERF),
                            ("stability", _STAB)))))))

STRATEGY_SAMPLES = _struct(("experiment_id", S), ("service_name", S), ("strategy", S), ("status", S),
                           ("ts", T.TimestampType()), ("cpu_cores", D), ("memory_gb", D), ("replica_count", I),
                           ("elapsed_hours", D), ("p95_latency", D), ("avg_response_time", D), ("error_rate", D),
                           ("throughput", D), ("cpu_utilization", D))

PREDICTIONS = _struct(("service", S), ("target", S), ("model", S), ("idx", L), ("y_true", D), ("y_pred", D),
                      ("proba", D))
