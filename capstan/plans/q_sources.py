"""Registered source / sink queries (A-1..A-15): each writes data derived
from the given tables in the exported format into a fresh folder under the
shared checkpoint folder, reads it back with the reader and returns the
result, so reader and writer are checked end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as ex
from ..operators import grading as gr
from ..operators import strategy as st
from ..session import scratch_path, scratch_table
from ..sources import adapters as ad
from ..sources import readers as rd
from ..sources import writers as wr
from ..schemas import EXPERIMENTS_WIDE, INVENTORY, PODS
from .q_models import _COMP_SQL, _SCORE_SQL
from .q_strategy import _COST, _PERF, _STAB, _SUMMARY_SQL, _by_strategy
from .registry import register


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"io-{name}")


_WIDE_COLS = [f.name for f in EXPERIMENTS_WIDE.fields if f.name in
              ("timestamp", "experiment_id", "service", "scenario", "replica_count", "load_users",
               "cpu_cores_value", "mem_bytes_value", "net_rx_bytes_value", "net_tx_bytes_value",
               "pod_restarts_value")]


@register("experiments_csv", adapters=["experiments"],
          floats=["cpu_cores_value", "mem_bytes_value", "net_rx_bytes_value", "net_tx_bytes_value",
                  "pod_restarts_value"], sql="""
    SELECT "timestamp", experiment_id, service, scenario, replica_count, load_users, cpu_cores_value,
           mem_bytes_value,
           CASE WHEN service IN ('signup', 'view') THEN NULL ELSE net_rx_bytes_value END AS net_rx_bytes_value,
           CASE WHEN service IN ('signup', 'view') THEN NULL ELSE net_tx_bytes_value END AS net_tx_bytes_value,
           pod_restarts_value, 'csv' AS source
    FROM experiments""")
def experiments_csv(spark, sf):
    """A-11 (CSV, partitioned by service) + A-2 (header-drift-aware read) + A-1.
    Two services are written with fewer columns in another order (drift)."""
    root = _scratch(spark, "experiments")
    e = ad.experiments(spark, sf).select(*_WIDE_COLS)
    full = e.where(~F.col("service").isin("signup", "view"))
    drift = e.where(F.col("service").isin("signup", "view")).select(
        "service", "experiment_id", "timestamp", "pod_restarts_value", "mem_bytes_value", "cpu_cores_value",
        "load_users", "replica_count", "scenario")
    wr.write_experiments(full, root, fmt="csv", mode="append")
    wr.write_experiments(drift, root, fmt="csv", mode="append")
    back = rd.read_experiments(spark, root + "/*/*.csv", schema=EXPERIMENTS_WIDE, base_path=root)
    vcols = rd.value_columns(back)
    assert "cpu_cores_value" in vcols
    return back.select(*_WIDE_COLS, F.lit("csv").alias("source"))


@register("master_parquet", adapters=["experiments", "records"],
          floats=["cpu_cores_value", "requests_per_second"], sql="""
    SELECT e.experiment_id, e.event_id, e.service, e.cpu_cores_value,
           r.load_users * 2.0 AS requests_per_second, coalesce(r.replica_count, 0) AS replica_count
    FROM experiments e JOIN records r ON e.experiment_id = r.experiment_id
    WHERE r.status IN ('completed', 'completed_with_warnings')""")
def master_parquet(spark, sf):
    """A-12: the master table (X-3) written as parquet and read back."""
    root = _scratch(spark, "master")
    e = ad.experiments(spark, sf).select("experiment_id", "event_id", "service", "cpu_cores_value")
    m = ex.build_master(ad.records(spark, sf), e)
    wr.write_master(m, root)
    return spark.read.parquet(root).select("experiment_id", "event_id", "service", "cpu_cores_value",
                                           "requests_per_second", "replica_count")


@register("experiment_records", adapters=["records"], sql="""
    SELECT experiment_id, target_service, replica_count, load_users, status FROM records
    WHERE status IN ('completed', 'completed_with_warnings') AND target_service IN ('click', 'view')""")
def experiment_records(spark, sf):
    """A-3: experiment records as JSON, finished runs of two services read back."""
    root = _scratch(spark, "records")
    ad.records(spark, sf).write.json(root)
    r = rd.read_experiment_records(spark, root, services=["click", "view"], multiline=False)
    return r.select("experiment_id", "target_service", "replica_count", "load_users", "status")


@register("range_results", adapters=["counters"], floats=["value"], sql="""
    SELECT metric, service, ts, value FROM counters""")
def range_results(spark, sf):
    """A-4: counters exported as range-query JSON, documents per (service, day)
    of a bounded number of samples, rotating through the three response layouts, read back."""
    root = _scratch(spark, "range")
    c = ad.counters(spark, sf)
    epoch = F.format_string("%.6f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    c = wr.documents_of(c.withColumn("day", F.to_date("ts")), ["metric", "service", "day"])
    per = c.groupBy("metric", "service", "day", "_doc").agg(
        F.collect_list(F.array(epoch, F.col("value").cast("string"))).alias("values"))
    item = F.array(F.struct(F.create_map(F.lit("__name__"), F.col("metric"), F.lit("service"), F.col("service"))
                            .alias("metric"), F.col("values").alias("values")))
    layout = F.pmod(F.dayofmonth("day"), F.lit(3))
    doc = (F.when(layout == 0, F.to_json(F.struct(F.struct(item.alias("result")).alias("data"))))
           .when(layout == 1, F.to_json(F.struct(item.alias("result"))))
           .otherwise(F.to_json(item)))
    per.select(doc.alias("value")).write.text(root)
    back = rd.read_range_results(spark, root, whole_files=False)
    return back.select("metric", F.col("labels")["service"].alias("service"),
                       F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@register("instant_vector", adapters=["samples"], floats=["value"], sql="""
    SELECT pod, 'app' AS container, CASE WHEN metric = 'cpu_cores' THEN 'cpu' ELSE 'memory' END AS resource,
           arg_max(value, (ts, seq)) AS value
    FROM samples GROUP BY pod, metric""")
def instant_vector(spark, sf):
    """A-5 + A-6: latest value per (pod, metric) exported as instant-vector
    responses (a bounded number of pods each) and read back as resource rows."""
    root = _scratch(spark, "vector")
    s = ad.samples(spark, sf)
    last = s.groupBy("metric", "pod", "container").agg(
        F.max_by(F.struct(F.col("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")),
                 F.struct("ts", "seq")).alias("v"))
    item = F.struct(F.create_map(F.lit("pod"), F.col("pod"), F.lit("container"), F.col("container"),
                                 F.lit("resource"), F.when(F.col("metric") == "cpu_cores", "cpu").otherwise("memory"))
                    .alias("metric"),
                    F.array(F.format_string("%.6f", F.col("v.t") / 1e6), F.col("v.value").cast("string")).alias("value"))
    docs = wr.documents_of(last, ["metric"]).groupBy("metric", "_doc").agg(
        F.collect_list(item).alias("result"))
    docs.select(F.to_json(F.struct(F.lit("success").alias("status"),
                                   F.struct(F.lit("vector").alias("resultType"), "result").alias("data")))
                .alias("value")).write.text(root)
    return rd.resource_requests(rd.read_instant_vector(spark, root, whole_files=False))


@register("inventory", adapters=["containers"], sql="""
    SELECT service || '-' || (CAST(substr(container, 3) AS BIGINT) % 40) AS owner, namespace, container,
           'img/' || service AS image, cpu_request, memory_request, cpu_request AS cpu_limit,
           memory_request AS memory_limit, CAST(substr(container, 3) AS BIGINT) % 7 <> 0 AS ready,
           CAST(CAST(substr(container, 3) AS BIGINT) % 3 AS INTEGER) AS restart_count
    FROM containers""")
def inventory(spark, sf):
    """A-7: pods with containers and statuses exported as JSON and flattened
    back to one row per container."""
    root = _scratch(spark, "pods")
    c = ad.containers(spark, sf).withColumn("_k", F.substring("container", 3, 20).cast("long"))
    c = wr.documents_of(c.withColumn("_name", F.concat_ws("-", "service", (F.col("_k") % 40).cast("string"))), ["_name"])
    pods = c.groupBy(F.col("_name").alias("name"), "namespace", "service", "_doc").agg(
        F.collect_list(F.struct(F.col("container").alias("name"), F.concat(F.lit("img/"), "service").alias("image"),
                                F.create_map(F.lit("cpu"), F.col("cpu_request"), F.lit("memory"),
                                             F.col("memory_request")).alias("requests"),
                                F.create_map(F.lit("cpu"), F.col("cpu_request"), F.lit("memory"),
                                             F.col("memory_request")).alias("limits"))).alias("containers"),
        F.collect_list(F.struct(F.col("container").alias("name"), (F.col("_k") % 7 != 0).alias("ready"),
                                (F.col("_k") % 3).cast("int").alias("restart_count"),
                                F.lit("running").alias("state"))).alias("statuses"))
    pods.select("name", "namespace", F.lit("Running").alias("status"), F.lit(None).cast("string").alias("node_name"),
                F.create_map(F.lit("app"), F.col("service")).alias("labels"), "containers", "statuses") \
        .write.json(root)
    back = spark.read.schema(PODS).json(root)
    assert set(INVENTORY.fieldNames()) - {"replicas", "ready_replicas"} <= set(back.columns)
    return rd.flatten_inventory(back)


@register("request_log", floats=["success_rate", "avg_response_time", "throughput"], sql="""
    SELECT event_type AS label, count(*) AS total_requests,
           count(*) FILTER (WHERE event_type <> 'error') AS successful_requests,
           count(*) FILTER (WHERE event_type = 'error') AS failed_requests,
           count(*) FILTER (WHERE event_type <> 'error') / count(*) * 100 AS success_rate,
           avg(floor(value)) AS avg_response_time, CAST(max(floor(value)) AS BIGINT) AS max_response_time,
           CAST(min(floor(value)) AS BIGINT) AS min_response_time,
           CASE WHEN max(epoch_ms(ts)) = min(epoch_ms(ts)) THEN NULL
                ELSE count(*) * 1000.0 / (max(epoch_ms(ts)) - min(epoch_ms(ts))) END AS throughput
    FROM events GROUP BY event_type""")
def request_log(spark, sf):
    """A-9 + L-1: the request log written as CSV (header), read back typed and
    summarised per label."""
    root = _scratch(spark, "jtl")
    h = ad.http(spark, sf)
    h.select("timeStamp", "elapsed", "label", F.col("status").alias("responseCode"), "success") \
        .write.option("header", True).csv(root)
    back = rd.read_request_log(spark, root)
    return st.load_summary(back, keys=("label",))


@register("strategy_results", adapters=["strategy_samples"],
          floats=["total_cpu_hours", "avg_p95_latency", "avg_volatility"], sql=f"""
    SELECT experiment_id, service_name, strategy, status, data_points, total_cpu_hours, avg_p95_latency,
           scaling_events, avg_volatility FROM ({_SUMMARY_SQL}) s""")
def strategy_results(spark, sf):
    """A-10: experiment summaries written as nested comparative-results JSON
    (documents of a bounded number of experiments) and flattened back."""
    root = _scratch(spark, "results")
    s = st.experiment_summary(ad.strategy_samples(spark, sf))
    exp = F.struct("experiment_id", "service_name", "strategy", "status", F.struct(
        "data_points",
        F.struct("total_cpu_hours", "total_memory_hours", "avg_cpu_cores", "avg_memory_gb").alias("cost_efficiency"),
        F.struct("avg_p95_latency", "max_p95_latency", "avg_error_rate", "avg_throughput")
        .alias("performance_integrity"),
        F.struct("scaling_events", "avg_volatility", "max_volatility").alias("stability")).alias("summary"))
    s = wr.documents_of(s, ["service_name"])
    s.groupBy("service_name", "_doc").agg(F.collect_list(exp).alias("experiments")).drop("_doc").write.json(root)
    back = rd.read_strategy_results(spark, root, multiline=False)
    return back.select("experiment_id", "service_name", "strategy", "status", "data_points", "total_cpu_hours",
                       "avg_p95_latency", "scaling_events", "avg_volatility")


def _report_sql() -> str:
    rows, titles = [], [("# Comparative report: all",)]
    for title, cols in wr.REPORT_SECTIONS:
        titles += [(f"## {title}",), (" | ".join(["| strategy", *[t for t, _, _ in cols]]) + " |",), ("| --- " * (len(cols) + 1) + "|",)]
        cells = " || ' | ' || ".join(f"printf('%.{d}f', coalesce(CAST({c} AS DOUBLE), 0.0))" for _, c, d in cols)
        rows.append(f"SELECT '| ' || strategy || ' | ' || {cells} || ' |' AS value FROM r")
    heads = ", ".join(f"('{t}')" for (t,) in titles)
    return " UNION ALL ".join([f"SELECT * FROM (VALUES {heads}) h(value)", *rows])


@register("strategy_report_markdown", adapters=["strategy_samples"], sql=f"""
    WITH r AS ({_by_strategy(f"{_COST}, {_PERF}, {_STAB}")}),
    o AS (SELECT max(CASE WHEN strategy = 'statistical' THEN mean_cpu_hours END) AS bc,
                 max(CASE WHEN strategy = 'predictive' THEN mean_cpu_hours END) AS cc,
                 max(CASE WHEN strategy = 'statistical' THEN mean_memory_hours END) AS bm,
                 max(CASE WHEN strategy = 'predictive' THEN mean_memory_hours END) AS cm FROM r),
    p AS (SELECT CASE WHEN bc > 0 THEN (bc - cc) / bc * 100 ELSE 0.0 END AS c, CASE WHEN bm > 0 THEN (bm - cm) / bm * 100 ELSE 0.0 END AS m
          FROM o WHERE bc IS NOT NULL AND cc IS NOT NULL)
    {_report_sql()}
    UNION ALL SELECT 'Savings of predictive over statistical: cpu ' || printf('%.2f', c) || '%, memory ' || printf('%.2f', m)
                     || '%, overall ' || printf('%.2f', (c + m) / 2.0) || '%' FROM p""")
def strategy_report_markdown(spark, sf):
    """A-13: the comparative report as markdown lines."""
    s = st.experiment_summary(ad.strategy_samples(spark, sf))
    lines = wr.strategy_report_lines(st.strategy_report(s), st.savings(st.cost_by_strategy(s)), "all")
    root = _scratch(spark, "report")
    wr.write_report(lines, root)
    return spark.read.text(root)


@register("strategy_report_json", adapters=["strategy_samples"], floats=["mean_cpu_hours", "mean_p95_latency", "max_volatility"], sql=f"""
    SELECT 'all' AS service_name, strategy, mean_cpu_hours, mean_p95_latency, max_volatility, total_scaling_events
    FROM ({_by_strategy(f"{_COST}, {_PERF}, {_STAB}")}) r""")
def strategy_report_json(spark, sf):
    """A-13: the report as one JSON document, written and read back."""
    s = st.experiment_summary(ad.strategy_samples(spark, sf))
    root = _scratch(spark, "report")
    wr.write_report(wr.strategy_report_lines(st.strategy_report(s), None, "all", fmt="json"), root)
    doc = spark.read.json(root)
    rows = doc.select("service_name", F.explode(F.arrays_zip("cost_efficiency", "performance_integrity", "stability")).alias("z"))
    return rows.select("service_name", F.col("z.cost_efficiency.strategy").alias("strategy"), "z.cost_efficiency.mean_cpu_hours",
                       "z.performance_integrity.mean_p95_latency", "z.stability.max_volatility", "z.stability.total_scaling_events")


@register("metrics_json", adapters=["strategy_samples"], floats=["cpu_hours", "avg_p95"], sql=f"""
    SELECT s.experiment_id, s.n_samples, s.cpu_hours, x.avg_p95_latency AS avg_p95
    FROM (SELECT experiment_id, count(*) AS n_samples, sum(cpu_cores * elapsed_hours) AS cpu_hours
          FROM strategy_samples GROUP BY experiment_id) s
    JOIN ({_SUMMARY_SQL}) x ON x.experiment_id = s.experiment_id""")
def metrics_json(spark, sf):
    """A-14: samples and summaries written as JSON and read back, joined per experiment."""
    root = _scratch(spark, "metrics")
    smp = ad.strategy_samples(spark, sf)
    wr.write_metrics(smp, st.experiment_summary(smp), root)
    a = spark.read.json(root + "/samples").groupBy("experiment_id").agg(
        F.count("*").alias("n_samples"), F.sum(F.col("cpu_cores") * F.col("elapsed_hours")).alias("cpu_hours"))
    b = spark.read.json(root + "/summary").select("experiment_id", F.col("avg_p95_latency").alias("avg_p95"))
    return a.join(b, "experiment_id")


@register("evaluation_report", adapters=["model_results"], sql=f"""
    WITH c AS ({_COMP_SQL}), s AS ({_SCORE_SQL})
    SELECT CASE WHEN overall_score IS NULL THEN service || ': no successful result'
                ELSE service || ': overall score ' || printf('%.1f', overall_score) || '% (' ||
                     CASE WHEN overall_score >= 80 THEN 'excellent' WHEN overall_score >= 60 THEN 'good'
                          WHEN overall_score >= 40 THEN 'acceptable' ELSE 'below_standard' END || ')' END AS value FROM s
    UNION ALL
    SELECT 'Services: ' || count(*) || ', failed ' || (count(*) - count(overall_score)) || ', average score '
           || printf('%.1f', avg(overall_score)) || '%, excellent ' || count(*) FILTER (WHERE overall_score >= 80)
           || ', good ' || count(*) FILTER (WHERE overall_score >= 60 AND overall_score < 80)
           || ', acceptable ' || count(*) FILTER (WHERE overall_score >= 40 AND overall_score < 60)
           || ', below ' || count(*) FILTER (WHERE overall_score < 40) FROM s
    UNION ALL
    SELECT service || ' / ' || target || ' / ' || model || ': ' ||
           {" || ', ' || ".join(f"'{n} ' || CASE WHEN {n}_compliant THEN 'pass' WHEN NOT {n}_compliant THEN 'fail' ELSE 'none' END"
                                for n in ("mse", "mae", "r2", "overall", "confidence"))} FROM c
    UNION ALL
    SELECT p.target || ': mean score ' || printf('%.1f', avg(s.overall_score)) || '% over ' || count(*) || ' services'
    FROM (SELECT DISTINCT service, target FROM c WHERE status = 'success') p JOIN s ON p.service = s.service GROUP BY p.target""")
def evaluation_report(spark, sf):
    """A-15: fleet, per-service and per-target standards lines."""
    comp = scratch_table(gr.compliance(ad.model_results(spark, sf), keys=("service", "target", "model")), "compliance")
    scores = gr.overall_score(comp).withColumn("band", gr.score_band(F.col("overall_score")))
    lines = wr.evaluation_lines(scores, gr.evaluation_summary(scores), comp, gr.score_by_target(comp, scores))
    root = _scratch(spark, "evaluation")
    wr.write_report(lines, root)
    return spark.read.text(root)


@register("pod_usage", adapters=["samples"], floats=["cpu_usage", "memory_usage"], sql="""
    SELECT pod, 'app' AS container,
           arg_max(value, (ts, seq)) FILTER (WHERE metric = 'cpu_cores') AS cpu_usage,
           arg_max(value, (ts, seq)) FILTER (WHERE metric = 'mem_bytes') AS memory_usage
    FROM samples WHERE contains(pod, 'pod-1') GROUP BY pod""")
def pod_usage(spark, sf):
    """A-8: per-pod usage lists (latest cpu and memory per container) written
    as JSON and flattened back for the pods of one service name pattern."""
    root = _scratch(spark, "usage")
    s = ad.samples(spark, sf)
    last = s.groupBy("pod", "container").agg(
        F.max_by(F.when(F.col("metric") == "cpu_cores", F.col("value")),
                 F.when(F.col("metric") == "cpu_cores", F.struct("ts", "seq"))).alias("cpu"),
        F.max_by(F.when(F.col("metric") == "mem_bytes", F.col("value")),
                 F.when(F.col("metric") == "mem_bytes", F.struct("ts", "seq"))).alias("mem"))
    usage = last.groupBy("pod").agg(F.collect_list(F.struct(
        F.col("container").alias("name"),
        F.struct(F.col("cpu").alias("cpu"), F.col("mem").alias("memory")).alias("usage"))).alias("containers"))
    usage.write.json(root)
    back = spark.read.schema("pod string, containers array<struct<name string, usage struct<cpu double, "
                             "memory double>>>").json(root)
    return rd.flatten_usage(back, "pod-1").select("pod", "container", F.col("cpu_usage"), F.col("memory_usage"))
