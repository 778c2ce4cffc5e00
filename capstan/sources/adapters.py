"""Adapters: the driver's test tables -> the capacity schemas of FIXTURES.md.

Each adapter is a lazy DataFrame over the given parquet tables, so the work
grows with the data.  The same mapping is written once more as DuckDB SQL in
:mod:`capstan.plans.oracle` so that both sides start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names used by the adapters.
SERVICES = ["click", "error", "purchase", "signup", "view"]
SCENARIOS = ["browsing", "checkout"]
REPLICA_LEVELS = [1, 2, 4]
USER_LEVELS = [5, 10, 20, 30, 50, 75]
STRATEGIES = ["statistical", "predictive", "hpa", "statistical"]
STRATEGY_SERVICES = ["frontend", "cartservice", "checkoutservice"]
TARGETS = {"F": "cpu_target", "O": "memory_target", "P": "replica_target"}
MODELS = ["forest", "boosted", "seasonal"]
BUCKET_BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, float("inf")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def _pick(values, index_col) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index_col + 1).cast("int"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric samples: cpu_cores and mem_bytes rows per event (one scan)."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(ev: DataFrame) -> DataFrame:
    """The samples mapping on an events frame (batch or stream: projection only)."""
    pod = F.concat(F.lit("pod-"), F.col("user_id").cast("string"))
    pairs = F.array(
        F.struct(F.lit("cpu_cores").alias("metric"), (F.col("value") / 1000.0).alias("value")),
        F.struct(F.lit("mem_bytes").alias("metric"),
                 ((F.lit(64) + _k()) * 1048576.0).alias("value")),
    )
    return (ev.select(
        F.col("event_type").alias("service"),
        F.lit("default").alias("namespace"),
        pod.alias("pod"),
        F.lit("app").alias("container"),
        F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("instance"),
        F.col("ts"), F.col("event_id").alias("seq"),
        F.inline(pairs))
        .withColumn("labels", F.create_map(F.lit("service"), F.col("service"),
                                           F.lit("pod"), F.col("pod")))
        .select("metric", "service", "namespace", "pod", "container", "instance",
                "labels", "ts", "seq", "value"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter series per service: running sum of value inside each day, so the
    counter falls back at midnight (a reset)."""
    ev = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    w = (Window.partitionBy("event_type", day).orderBy("ts", "event_id")
         .rowsBetween(Window.unboundedPreceding, 0))
    return ev.select(
        F.lit("requests_total").alias("metric"),
        F.col("event_type").alias("service"),
        F.col("ts"), F.col("event_id").alias("seq"),
        F.sum("value").over(w).alias("value"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gauge series per (service, hour): available = sum(k), total = sum(k)+sum(value)."""
    ev = table(spark, sf_dir, "events")
    hourly = (ev.groupBy(F.col("event_type").alias("instance"),
                         F.date_trunc("hour", "ts").alias("ts"))
              .agg(F.sum(_k()).cast("double").alias("avail"), F.sum("value").alias("v")))
    return hourly.select(
        "instance", "ts",
        F.inline(F.array(
            F.struct(F.lit("mem_available").alias("metric"), F.col("avail").alias("value")),
            F.struct(F.lit("mem_total").alias("metric"), (F.col("avail") + F.col("v")).alias("value")))))


def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: status 500 for error events, latency = value/1000 s."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.col("ts"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("timeStamp"),
        F.floor("value").cast("long").alias("elapsed"),
        F.col("event_type").alias("label"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") / 1000.0).alias("latency_s"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency histogram per (service, day): le = .01 ... +Inf."""
    ev = table(spark, sf_dir, "events")
    lat = F.col("value") / 1000.0
    aggs = [F.count_if(lat <= b).alias(f"b{i}") if b != float("inf") else F.count("*").alias(f"b{i}")
            for i, b in enumerate(BUCKET_BOUNDS)]
    per_day = ev.groupBy(F.col("event_type").alias("service"),
                         F.to_date("ts").alias("day")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").cast("long").alias("cumulative"))
                     for i, b in enumerate(BUCKET_BOUNDS)])
    return per_day.select("service", F.col("day").cast("timestamp_ntz").alias("ts"), F.inline(rows))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide experiment table: one row per event, experiment from user_id."""
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id")
    k = _k()
    scenario = _pick(SCENARIOS, u % 2)
    replicas = _pick(REPLICA_LEVELS, F.floor(u / 2) % 3)
    users = _pick(USER_LEVELS, F.floor(u / 6) % 6)
    base = ev.select(
        F.col("event_id"), F.col("ts"),
        F.col("event_type").alias("service"),
        scenario.alias("scenario"),
        replicas.cast("int").alias("replica_count"),
        users.cast("int").alias("load_users"),
        (F.col("value") / 1000.0).alias("cpu_cores_value"),
        ((F.lit(64) + k) * 1048576.0).alias("mem_bytes_value"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("double"))
         .otherwise(k * 1024.0).alias("net_rx_bytes_value"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("double"))
         .otherwise(F.col("value") * 512.0).alias("net_tx_bytes_value"),
        F.floor(k / 25).cast("double").alias("pod_restarts_value"),
        replicas.cast("double").alias("replica_count_value"),
        k.cast("double").alias("node_cpu_util_value"),
        (F.lit(50.0) + F.col("value") / 10.0).alias("node_mem_util_value"))
    exp_id = F.format_string("%s_%s_replicas_%d_users_%d", "service", "scenario",
                             "replica_count", "load_users")
    from ..operators.windows import dense_position
    pos = dense_position(base.withColumn("experiment_id", exp_id), ["experiment_id"], ["ts", "event_id"], "idx")
    return pos.withColumn("timestamp", F.concat(F.lit("t_"), F.col("idx").cast("string")))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``experiments`` with cpu NULL where event_id % 7 = 0."""
    return experiments(spark, sf_dir).withColumn(
        "cpu_cores_value",
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("cpu_cores_value")))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container inventory from ``part``: request texts in every supported form."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    m6 = key % 6
    dec = F.concat(F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"))
    cpu = (F.when(m6 == 0, F.concat((size * 10).cast("string"), F.lit("m")))
           .when(m6 == 1, size.cast("string"))
           .when(m6 == 2, F.lit("Unknown"))
           .when(m6 == 3, F.concat((size * 100).cast("string"), F.lit("m")))
           .when(m6 == 4, dec)
           .otherwise(F.lit("")))
    mem = (F.when(m6 == 0, F.concat((size * 16).cast("string"), F.lit("Mi")))
           .when(m6 == 1, F.concat((size * 16 * 1024).cast("string"), F.lit("Ki")))
           .when(m6 == 2, F.concat(dec, F.lit("Gi")))
           .when(m6 == 3, F.concat((size * 16).cast("string"), F.lit("M")))
           .when(m6 == 4, (size.cast("long") * 16 * 1048576).cast("string"))
           .otherwise(F.lit("")))
    return p.select(
        _pick(SERVICES, key % 5).alias("service"),
        F.lit("default").alias("namespace"),
        F.concat(F.lit("c-"), key.cast("string")).alias("container"),
        cpu.alias("cpu_request"), mem.alias("memory_request"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' predictions per order (idx = o_orderkey is unique)."""
    o = table(spark, sf_dir, "orders")
    y = F.col("o_totalprice")
    preds = F.array(
        F.struct(F.lit(MODELS[0]).alias("model"),
                 (y * (1 + ((F.col("o_orderkey") % 7) - 3) / 100.0)).alias("y_pred")),
        F.struct(F.lit(MODELS[1]).alias("model"), (y * 0.9 + 1000.0).alias("y_pred")),
        F.struct(F.lit(MODELS[2]).alias("model"),
                 (y + ((F.col("o_custkey") % 11) - 5) * 100.0).alias("y_pred")))
    target = (F.when(F.col("o_orderstatus") == "F", TARGETS["F"])
              .when(F.col("o_orderstatus") == "O", TARGETS["O"]).otherwise(TARGETS["P"]))
    return o.select(
        F.concat(F.lit("svc-"), (F.col("o_custkey") % 5).cast("string")).alias("service"),
        target.alias("target"),
        F.col("o_orderkey").alias("idx"),
        y.alias("y_true"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("int").alias("label"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("proba"),
        F.inline(preds)).select("service", "target", "model", "idx", "y_true", "y_pred", "label", "proba")


def strategy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy experiment samples; experiment = user, strategy by user_id % 4."""
    return strategy_samples_of(table(spark, sf_dir, "events"))


def strategy_samples_of(ev: DataFrame) -> DataFrame:
    """The strategy-samples mapping on an events frame (batch or stream)."""
    u = F.col("user_id")
    k = _k()
    return ev.select(
        F.concat(F.lit("exp-"), u.cast("string")).alias("experiment_id"),
        _pick(STRATEGY_SERVICES, u % 3).alias("service_name"),
        _pick(STRATEGIES, u % 4).alias("strategy"),
        F.when(u % 4 == 3, "failed").otherwise("success").alias("status"),
        F.col("ts"), F.col("event_id").alias("seq"),
        (F.col("value") / 100.0).alias("cpu_cores"),
        ((F.lit(64) + k) / 64.0).alias("memory_gb"),
        ((k % 3) + 1).cast("int").alias("replica_count"),
        F.lit(1.0 / 120.0).alias("elapsed_hours"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("value") / 1000.0).alias("p95_latency"),
        (F.col("value") / 2000.0).alias("avg_response_time"),
        (k / 1000.0).alias("error_rate"),
        F.col("value").alias("throughput"),
        (F.col("value") / 500.0).alias("cpu_utilization"))


# Per-target scale of the model_results adapter
# (mse factor, mae factor, r2 divisor or multiplier).
RESULT_SCALES = {"cpu_target": (1e-7, 2e-4), "memory_target": (1e7, 3.3e5), "replica_target": (5e-6, 1e-3)}


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (service, target, model) results scaled into the standards' ranges;
    the results of one service all failed, another has one failed target."""
    from ..operators.ensemble import confidence

    p = predictions(spark, sf_dir)
    e = F.col("y_pred") - F.col("y_true")
    agg = p.groupBy("service", "target", "model").agg(F.avg(e * e).alias("m"), F.avg(F.abs(e)).alias("a"))
    t, m, a = F.col("target"), F.col("m"), F.col("a")
    mse = (F.when(t == "cpu_target", m * 1e-7).when(t == "memory_target", m * 1e7).otherwise(m * 5e-6))
    mae = (F.when(t == "cpu_target", a * 2e-4).when(t == "memory_target", a * 3.3e5).otherwise(a * 1e-3))
    r2 = (F.when(t == "cpu_target", 1 - m / 1.4e5).when(t == "memory_target", -5 * m / 1e5)
          .otherwise(1 - m / 1.6e5))
    lost = (F.col("service") == "svc-3") | ((F.col("service") == "svc-4") & (t == "replica_target"))
    return agg.select("service", "target", "model", F.when(lost, "failed").otherwise("success").alias("status"),
                      mse.alias("mse"), mae.alias("mae"), r2.alias("r2"), confidence(m / 333.0).alias("confidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment records (one per experiment id) with a run status."""
    e = experiments(spark, sf_dir)
    r = e.select("experiment_id", F.col("service").alias("target_service"), "scenario",
                 "replica_count", "load_users").distinct()
    status = (F.when((F.col("load_users") == 75) & (F.col("scenario") == "checkout"), "failed")
              .when((F.col("load_users") == 5) & (F.col("replica_count") == 4), "skipped")
              .when(F.col("replica_count") == 4, "completed_with_warnings").otherwise("completed"))
    return r.withColumn("status", status)


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments: containers grouped per (service, p_partkey % 40)."""
    c = table(spark, sf_dir, "part").select(
        _pick(SERVICES, F.col("p_partkey") % 5).alias("service"),
        (F.col("p_partkey") % 40).alias("shard"), F.col("p_partkey"), F.col("p_size"))
    return c.groupBy(F.concat_ws("-", "service", F.col("shard").cast("string")).alias("name"), "service").agg(
        F.count("*").cast("int").alias("replicas"),
        F.count_if(F.col("p_size") > 5).cast("int").alias("ready_replicas"),
        F.count_distinct("p_partkey").alias("n_containers"),
        # a deployment's containers: bounded by its pod template, here the parts of one shard
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("c-"), F.col("p_partkey").cast("string")).alias("name")))).alias("containers"))


HTTP_SOURCES = ["ingress_requests", "mesh_requests", "http_requests"]


def http_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counters per (source metric, service, status): requests so far in
    the day.  svc-0 is seen by the ingress and by itself, svc-1 by the mesh, the
    others by themselves."""
    u = F.col("user_id") % 5
    sources = F.when(u == 0, F.array(F.lit("ingress_requests"), F.lit("http_requests"))) \
        .when(u == 1, F.array(F.lit("mesh_requests"))).otherwise(F.array(F.lit("http_requests")))
    ev = table(spark, sf_dir, "events").select(
        F.explode(sources).alias("metric"), F.concat(F.lit("svc-"), u.cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), "ts", F.col("event_id").alias("seq"))
    w = Window.partitionBy("metric", "service", "status", F.to_date("ts")).orderBy("ts", "seq").rowsBetween(
        Window.unboundedPreceding, 0)
    return ev.withColumn("value", F.count(F.lit(1)).over(w).cast("double"))


# Metrics of the raw adapter, their service ('node' for node
# metrics), whether they count up, and their value as a function of value v and k.
RAW_METRICS = [
    ("cpu_seconds", False, True, "v / 1000.0"), ("net_rx", False, True, "k * 10.0"), ("net_tx", False, True, "v * 2.0"),
    ("fs_read", False, True, "k * 3.0"), ("fs_write", False, True, "v * 0.5"), ("restarts", False, True, "floor(k / 25.0) * 1.0"),
    ("mem_working_set", False, False, "(64 + k) * 1048576.0"), ("replicas", False, False, "(k % 3) + 1.0"),
    ("pod_phase", False, False, "(k % 2) * 1.0"), ("node_idle", True, True, "v / 2000.0"),
    ("mem_available", True, False, "k * 1.0"), ("mem_total", True, False, "k * 1.0 + v"),
]


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw series (metric, service, instance): counters sum up within the day."""
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", F.col("value").alias("v"), _k().cast("double").alias("k"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(node).alias("node"), F.lit(up).alias("up"), F.expr(x).cast("double").alias("x"))
                     for m, node, up, x in RAW_METRICS])
    ev = ev.select("event_type", F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("instance"), "ts",
                   F.col("event_id").alias("seq"), F.inline(rows))
    ev = ev.withColumn("service", F.when(F.col("node"), "node").otherwise(F.col("event_type")))
    w = Window.partitionBy("metric", "service", "instance", F.to_date("ts")).orderBy("ts", "seq").rowsBetween(
        Window.unboundedPreceding, 0)
    return ev.select("metric", "service", "instance", "ts", "seq", F.when(F.col("up"), F.sum("x").over(w)).otherwise(F.col("x")).alias("value"))
