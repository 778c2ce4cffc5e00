"""Registered queries: identifiers and time features (Q-5..Q-14), experiment
tables (X-*) and data quality (G-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefeat as tf
from ..operators import experiments as ex
from ..operators import quality as qa
from ..sources import adapters as ad
from .registry import register

_USERS_DONE = (5, 20, 50)


@register("parse_experiment_id", adapters=["experiments"], sql="""
    SELECT DISTINCT experiment_id, regexp_extract(experiment_id, '^(.*?)_(browsing|checkout)_', 1) AS service,
           CASE WHEN experiment_id LIKE '%\\_checkout\\_%' ESCAPE '\\' THEN 'checkout' ELSE 'browsing' END AS scenario,
           TRY_CAST(regexp_extract(experiment_id, '_replicas_(\\d+)', 1) AS INTEGER) AS replica_count,
           TRY_CAST(regexp_extract(experiment_id, '_users_(\\d+)', 1) AS INTEGER) AS load_users
    FROM experiments""")
def parse_experiment_id(spark, sf):
    """Q-5 (ids built by the adapter) and Q-6 (parsed back)."""
    e = ad.experiments(spark, sf).select("experiment_id").distinct()
    p = tf.parse_experiment_id("experiment_id")
    return e.select("experiment_id", p.service.alias("service"), p.scenario.alias("scenario"),
                    p.replica_count.alias("replica_count"), p.load_users.alias("load_users"))


_TS_SQL = "CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE \"timestamp\" END"


@register("sample_index", adapters=["experiments"], sql=f"""
    SELECT experiment_id, event_id,
           CAST(CASE WHEN avg(CAST(starts_with(ts_text, 't_') AS DOUBLE)) OVER p = 1.0
                THEN TRY_CAST(regexp_extract(ts_text, '^t_(\\d+)$', 1) AS BIGINT) END AS DOUBLE) AS time_index_strict,
           CAST(CASE WHEN avg(CAST(starts_with(ts_text, 't_') AS DOUBLE)) OVER p > 0.8
                THEN coalesce(TRY_CAST(regexp_extract(ts_text, '^t_(\\d+)$', 1) AS BIGINT), 0) END AS DOUBLE)
             AS time_index_lenient
    FROM (SELECT experiment_id, event_id, {_TS_SQL} AS ts_text FROM experiments) e
    WINDOW p AS (PARTITION BY experiment_id)""")
def sample_index(spark, sf):
    """Q-7: both gates over texts where 2 % of the rows are not ``t_<n>``."""
    e = ad.experiments(spark, sf).select(
        "experiment_id", "event_id",
        F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("timestamp")).alias("ts_text"))
    a = tf.with_sample_index(e, "ts_text", ["experiment_id"], "strict", "time_index_strict")
    b = tf.with_sample_index(a, "ts_text", ["experiment_id"], "lenient", "time_index_lenient")
    # nullable indices are compared as doubles (same values, one numeric kind on both sides)
    return b.select("experiment_id", "event_id", F.col("time_index_strict").cast("double").alias("time_index_strict"),
                    F.col("time_index_lenient").cast("double").alias("time_index_lenient"))


@register("calendar_features", adapters=["experiments"],
          floats=["minutes_since_start", "hour_sin", "hour_cos", "day_sin", "day_cos"], sql="""
    SELECT event_id, experiment_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
           CAST(isodow(ts) - 1 IN (5, 6) AS INTEGER) AS is_weekend,
           idx % 24 AS idx_hour, (idx // 24) % 7 AS idx_day_of_week,
           CAST((idx // 24) % 7 IN (5, 6) AS INTEGER) AS idx_is_weekend,
           (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY experiment_id))) / 1e6 / 60.0 AS minutes_since_start,
           sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
           sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos
    FROM experiments""")
def calendar_features(spark, sf):
    """Q-8 (from ts and from idx), Q-9 and Q-10 per row."""
    e = ad.experiments(spark, sf)
    e = tf.minutes_since_start(e, "ts", ["experiment_id"])
    cal = tf.calendar_from_ts("ts")
    ical = [c.alias("idx_" + n) for c, n in zip(tf.calendar_from_index("idx"),
                                                 ["hour", "day_of_week", "is_weekend"])]
    e = e.select("event_id", "experiment_id", "ts", "idx", "minutes_since_start", *cal, *ical)
    return e.select("event_id", "experiment_id", "hour", "day_of_week", "is_weekend", "idx_hour",
                    "idx_day_of_week", "idx_is_weekend", "minutes_since_start",
                    *tf.cyclical("hour", "day_of_week"))


def _bin_sql(x: str, edges, labels) -> str:
    arms = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = f"{x} > {lo} AND {x} <= {hi}" if hi != float("inf") else f"{x} > {lo}"
        arms.append(f"WHEN {cond} THEN '{lab}'")
    return f"(CASE {' '.join(arms)} ELSE 'nan' END)"


@register("numeric_features", adapters=["gappy"],
          floats=["cpu_per_replica", "mem_log", "cpu_target", "memory_target", "replica_target"], sql=f"""
    SELECT event_id, cpu_cores_value / greatest(replica_count, 1) AS cpu_per_replica,
           ln(1 + abs(mem_bytes_value)) AS mem_log,
           {_bin_sql('cpu_cores_value', tf.REGIME_EDGES, tf.REGIME_LABELS)} AS cpu_level,
           {_bin_sql('cpu_cores_value', tf.REGIME_EDGES_ALT, tf.REGIME_LABELS)} AS cpu_level_alt,
           cpu_cores_value * 1.2 AS cpu_target, mem_bytes_value * 1.15 AS memory_target,
           replica_count_value * 1.0 AS replica_target
    FROM gappy""")
def numeric_features(spark, sf):
    """Q-11..Q-14: per-replica value, log, regime label bins, buffered targets."""
    g = ad.gappy(spark, sf)
    cpu = F.col("cpu_cores_value")
    return g.select(
        "event_id", tf.per_replica(cpu, F.col("replica_count")).alias("cpu_per_replica"),
        tf.log_abs("mem_bytes_value").alias("mem_log"),
        tf.bin_column(cpu, tf.REGIME_EDGES, tf.REGIME_LABELS).alias("cpu_level"),
        tf.bin_column(cpu, tf.REGIME_EDGES_ALT, tf.REGIME_LABELS).alias("cpu_level_alt"),
        tf.apply_buffer(cpu, tf.BUFFERS["cpu"]).alias("cpu_target"),
        tf.apply_buffer("mem_bytes_value", tf.BUFFERS["memory"]).alias("memory_target"),
        tf.apply_buffer("replica_count_value", tf.BUFFERS["replica"]).alias("replica_target"))


_UNIFY_SRC = "SELECT * FROM samples WHERE NOT (metric = 'mem_bytes' AND seq % 5 = 0)"


def _unify_input(spark, sf):
    s = ad.samples(spark, sf)
    return s.where(~((F.col("metric") == "mem_bytes") & (F.col("seq") % 5 == 0)))


@register("unify_metrics", adapters=["samples"], floats=["cpu_cores_value", "mem_bytes_value"], sql=f"""
    SELECT service, pod, idx, 't_' || idx AS "timestamp",
           max(CASE WHEN metric = 'cpu_cores' THEN value END) AS cpu_cores_value,
           max(CASE WHEN metric = 'mem_bytes' THEN value END) AS mem_bytes_value
    FROM (SELECT *, row_number() OVER (PARTITION BY service, pod, metric ORDER BY ts, seq) - 1 AS idx
          FROM ({_UNIFY_SRC}) s) p
    GROUP BY service, pod, idx""")
def unify_metrics(spark, sf):
    """X-1: cpu and (shorter) memory series aligned by position per pod."""
    return ex.unify_metrics(_unify_input(spark, sf), ["service", "pod"], ["cpu_cores", "mem_bytes"])


@register("unify_metrics_multi", adapters=["samples"], floats=["cpu_cores_value", "mem_bytes_value"], sql=f"""
    SELECT service, pod, idx, 't_' || idx AS "timestamp",
           max(CASE WHEN metric = 'cpu_cores' THEN value END) AS cpu_cores_value,
           CAST(max(CASE WHEN metric = 'cpu_cores' THEN seq END) AS DOUBLE) AS cpu_cores_seq,
           max(CASE WHEN metric = 'mem_bytes' THEN value END) AS mem_bytes_value,
           CAST(max(CASE WHEN metric = 'mem_bytes' THEN seq END) AS DOUBLE) AS mem_bytes_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY service, pod, metric ORDER BY ts, seq) - 1 AS idx
          FROM ({_UNIFY_SRC}) s) p
    GROUP BY service, pod, idx""")
def unify_metrics_multi(spark, sf):
    """X-2: every listed column kept per metric."""
    w = ex.unify_metrics_multi(_unify_input(spark, sf), ["service", "pod"], ["cpu_cores", "mem_bytes"],
                               ["value", "seq"])
    # the nullable sequence numbers are compared as doubles on both sides
    return w.withColumn("cpu_cores_seq", F.col("cpu_cores_seq").cast("double")) \
            .withColumn("mem_bytes_seq", F.col("mem_bytes_seq").cast("double"))


@register("build_master", adapters=["experiments", "records"],
          floats=["cpu_cores_value", "requests_per_second"], sql="""
    SELECT e.experiment_id, e.event_id, e.idx, e.service, r.target_service, e.cpu_cores_value,
           coalesce(CAST(NULL AS DOUBLE), r.load_users * 2.0) AS requests_per_second,
           coalesce(r.replica_count, 0) AS replica_count, r.load_users
    FROM experiments e JOIN records r ON e.experiment_id = r.experiment_id
    WHERE r.status IN ('completed', 'completed_with_warnings')""")
def build_master(spark, sf):
    """X-3: finished experiments joined to their tables with fallbacks."""
    e = ad.experiments(spark, sf).select("experiment_id", "event_id", "idx", "service", "cpu_cores_value")
    m = ex.build_master(ad.records(spark, sf), e)
    return m.select("experiment_id", "event_id", "idx", "service", "target_service", "cpu_cores_value",
                    "requests_per_second", "replica_count", "load_users")


_GRID_SQL = """
    SELECT service, scenario, replica_count, load_users,
           service || '_' || scenario || '_replicas_' || replica_count || '_users_' || load_users AS experiment_id
    FROM (SELECT DISTINCT event_type AS service FROM events) s,
         (VALUES ('browsing'), ('checkout')) a(scenario), (VALUES (1), (2), (4)) b(replica_count),
         (VALUES (5), (10), (20), (30), (50), (75)) c(load_users)"""
_DONE_SQL = "SELECT DISTINCT experiment_id FROM experiments WHERE load_users IN (5, 20, 50)"


def _grid(spark, sf):
    services = ad.table(spark, sf, "events").select(F.col("event_type").alias("service"))
    return ex.experiment_grid(services, ad.SCENARIOS, ad.REPLICA_LEVELS, ad.USER_LEVELS)


def _done(spark, sf):
    return ad.experiments(spark, sf).where(F.col("load_users").isin(*_USERS_DONE)).select("experiment_id").distinct()


@register("experiment_grid", sql=_GRID_SQL)
def experiment_grid(spark, sf):
    """X-4: services (from the data) x scenarios x replicas x users."""
    return _grid(spark, sf)


@register("remaining", adapters=["experiments"], sql=f"""
    SELECT g.* FROM ({_GRID_SQL}) g WHERE g.experiment_id NOT IN ({_DONE_SQL})""")
def remaining(spark, sf):
    """X-5: planned runs not yet done."""
    return ex.remaining(_grid(spark, sf), _done(spark, sf))


@register("progress", adapters=["experiments"], floats=["percent"], sql=f"""
    SELECT count(*) AS total, count(d.experiment_id) AS completed, count(*) - count(d.experiment_id) AS remaining,
           CASE WHEN count(*) > 0 THEN count(d.experiment_id) / count(*) * 100 ELSE 0.0 END AS percent
    FROM (SELECT DISTINCT experiment_id FROM ({_GRID_SQL}) g0) g LEFT JOIN ({_DONE_SQL}) d
      ON g.experiment_id = d.experiment_id""")
def progress(spark, sf):
    """X-6: plan progress."""
    return ex.progress(_grid(spark, sf), _done(spark, sf))


@register("next_runs", adapters=["experiments"], sql=f"""
    SELECT experiment_id FROM ({_GRID_SQL}) g WHERE experiment_id NOT IN ({_DONE_SQL})
    ORDER BY experiment_id LIMIT 10""")
def next_runs(spark, sf):
    """X-6: the next 10 runs (sorted)."""
    return ex.next_runs(_grid(spark, sf), _done(spark, sf))


@register("run_summary", adapters=["records"], floats=["success_rate"], sql="""
    SELECT count(*) AS total,
           count(*) FILTER (WHERE status IN ('completed', 'completed_with_warnings')) AS successful,
           count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
           count(*) FILTER (WHERE status IN ('completed', 'completed_with_warnings')) / count(*) * 100 AS success_rate
    FROM records""")
def run_summary(spark, sf):
    """X-7: outcome counts of all experiment records."""
    return ex.run_summary(ad.records(spark, sf))


@register("select_services", adapters=["containers"], sql="""
    SELECT DISTINCT container FROM containers
    WHERE contains(lower(container), 'c-1') OR contains(lower(container), lower('C-22'))""")
def select_services(spark, sf):
    """X-8: case-insensitive substring selection, distinct."""
    return ex.select_services(ad.containers(spark, sf), ["c-1", "C-22"], name="container")


@register("services_by_label", adapters=["samples"], sql="SELECT DISTINCT pod FROM samples WHERE service = 'click'")
def services_by_label(spark, sf):
    """X-9: pods whose labels carry service = click."""
    return ex.services_by_label(ad.samples(spark, sf), "service", "click").select("pod")


@register("service_labels", adapters=["samples"], sql="""
    SELECT DISTINCT pod, pod AS pod_label FROM samples""")
def service_labels(spark, sf):
    """X-9: name -> labels listing (a pod's service label differs by event, its
    pod label does not)."""
    return ex.service_labels(ad.samples(spark, sf)).select("pod", F.col("labels").getItem("pod").alias("pod_label"))


@register("service_status", adapters=["deployments"], sql="""
    SELECT name, replicas, ready_replicas,
           CASE WHEN ready_replicas = replicas THEN 'ready' ELSE 'not_ready' END AS status, n_containers, containers
    FROM deployments""")
def service_status(spark, sf):
    """X-10: readiness and container names per deployment."""
    return ex.service_status(ad.deployments(spark, sf)).withColumn("containers", F.array_join("containers", ","))


@register("system_summary", adapters=["deployments"], sql="""
    SELECT name, replicas, ready_replicas, n_containers, count(*) OVER () AS total_services
    FROM deployments ORDER BY name LIMIT 5""")
def system_summary(spark, sf):
    """X-11: first five deployments by name and the deployment count."""
    return ex.system_summary(ad.deployments(spark, sf))


@register("latest_window", adapters=["experiments"], floats=["cpu_cores_value"], sql="""
    SELECT experiment_id, event_id, idx, cpu_cores_value FROM experiments
    QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY ts DESC, event_id DESC) <= 20""")
def latest_window(spark, sf):
    """X-12: last 20 rows of every experiment."""
    e = ad.experiments(spark, sf).withColumnRenamed("event_id", "seq")
    out = ex.latest_window(e, ["experiment_id"], 20)
    return out.select("experiment_id", F.col("seq").alias("event_id"), "idx", "cpu_cores_value")


@register("numeric_only", adapters=["experiments"],
          floats=["cpu_cores_value", "mem_bytes_value", "net_rx_bytes_value", "net_tx_bytes_value", "pod_restarts_value",
                  "replica_count_value", "node_cpu_util_value", "node_mem_util_value"], sql="""
    SELECT replica_count, load_users, cpu_cores_value, mem_bytes_value, net_rx_bytes_value, net_tx_bytes_value,
           pod_restarts_value, replica_count_value, node_cpu_util_value, node_mem_util_value, idx FROM experiments""")
def numeric_only(spark, sf):
    """X-13: numeric columns of the experiment table."""
    return ex.numeric_only(ad.experiments(spark, sf), drop=["event_id"])


_WANTED_SQL = "SELECT DISTINCT event_type AS service FROM events UNION ALL SELECT 'cartservice'"


def _wanted(spark, sf):
    ev = ad.table(spark, sf, "events").select(F.col("event_type").alias("service")).distinct()
    return ev.unionByName(spark.createDataFrame([("cartservice",)], "service string"))


@register("existing_services", adapters=["containers"], sql=f"""
    SELECT w.service, CASE WHEN c.service IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
           CASE WHEN c.service IS NULL THEN 'Service ' || w.service || ' not found' END AS error
    FROM ({_WANTED_SQL}) w LEFT JOIN (SELECT DISTINCT service FROM containers WHERE service <> 'signup') c
      ON w.service = c.service""")
def existing_services(spark, sf):
    """X-14: requested services checked against the inventory (signup removed)."""
    inv = ad.containers(spark, sf).where(F.col("service") != "signup")
    return ex.existing_services(_wanted(spark, sf), inv)


_COMPLETE_SRC = "SELECT * FROM samples WHERE NOT (metric = 'mem_bytes' AND service = 'signup')"


@register("completeness", adapters=["samples"], floats=["completeness_pct"], sql=f"""
    SELECT service, found, 3 AS required, found / 3.0 * 100 AS completeness_pct, found / 3.0 * 100 >= 90 AS passed
    FROM (SELECT service, CAST(max(CAST(contains(metric, 'cpu') AS INTEGER)) + max(CAST(contains(metric, 'mem') AS INTEGER))
                        + max(CAST(contains(metric, 'requests_per_second') AS INTEGER)) AS INTEGER) AS found
          FROM ({_COMPLETE_SRC}) s GROUP BY service) a""")
def completeness(spark, sf):
    """G-1: required metric coverage per service."""
    s = ad.samples(spark, sf).where(~((F.col("metric") == "mem_bytes") & (F.col("service") == "signup")))
    return qa.completeness(s, ["service"])


_NULL_COLS = ["cpu_cores_value", "mem_bytes_value", "net_rx_bytes_value"]
_NULL_SQL = """
    SELECT experiment_id, metric, null_pct, null_pct <= 5.0 AS passed FROM (
      SELECT experiment_id,
             sum(CAST(cpu_cores_value IS NULL AS INTEGER)) / count(*) * 100 AS cpu_cores_value,
             sum(CAST(mem_bytes_value IS NULL AS INTEGER)) / count(*) * 100 AS mem_bytes_value,
             sum(CAST(net_rx_bytes_value IS NULL AS INTEGER)) / count(*) * 100 AS net_rx_bytes_value
      FROM gappy GROUP BY experiment_id) p
    UNPIVOT (null_pct FOR metric IN (cpu_cores_value, mem_bytes_value, net_rx_bytes_value))"""


@register("null_share", adapters=["gappy"], floats=["null_pct"], sql=_NULL_SQL)
def null_share(spark, sf):
    """G-2: NULL share of the critical columns per experiment."""
    return qa.null_share(ad.gappy(spark, sf), ["experiment_id"], _NULL_COLS)


_CV_COLS = ["cpu_cores_value", "mem_bytes_value"]
_CV_SQL = """
    WITH n AS (SELECT experiment_id, count(*) AS n_rows FROM gappy GROUP BY experiment_id),
    t AS (SELECT experiment_id, cpu_cores_value, mem_bytes_value FROM gappy
          QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY idx DESC) <= 20),
    l AS (SELECT * FROM t UNPIVOT INCLUDE NULLS (value FOR metric IN (cpu_cores_value, mem_bytes_value))),
    a AS (SELECT experiment_id, metric, count(value) AS n_values, avg(value) AS mean, stddev_samp(value) AS std
          FROM l GROUP BY experiment_id, metric)
    SELECT a.experiment_id, metric,
           CASE WHEN n_rows >= 10 AND n_values >= 5 AND mean > 0 THEN std / mean * 100 END AS cv_pct,
           CASE WHEN n_rows >= 10 AND n_values >= 5 AND mean > 0 THEN std / mean * 100 <= 10.0 END AS passed
    FROM a JOIN n ON a.experiment_id = n.experiment_id"""


@register("stability_cv", adapters=["gappy"], floats=["cv_pct"], sql=_CV_SQL)
def stability_cv(spark, sf):
    """G-3: CV of the last 20 rows per (experiment, metric)."""
    return qa.stability_cv(ad.gappy(spark, sf), ["experiment_id"], _CV_COLS)


# for the verdict: limits that some experiments meet, and metrics that some lack
_VERDICT_NULL, _VERDICT_CV = 20.0, 60.0


@register("quality_verdict", adapters=["gappy"], sql=f"""
    WITH e AS (SELECT DISTINCT experiment_id, load_users, replica_count FROM gappy),
    c AS (SELECT experiment_id, CASE WHEN load_users >= 30 THEN 3 ELSE 2 END AS found FROM e WHERE NOT (load_users = 75 AND replica_count = 4)),
    n AS (SELECT experiment_id, metric, null_pct FROM ({_NULL_SQL}) x WHERE null_pct > {_VERDICT_NULL}),
    v AS (SELECT experiment_id, metric, cv_pct FROM ({_CV_SQL}) y WHERE cv_pct > {_VERDICT_CV}),
    w AS (SELECT experiment_id, printf('Low data completeness: %.1f%%', found / 3.0 * 100) AS t FROM c WHERE found < 3
          UNION ALL SELECT experiment_id, 'High NULL share in ' || metric || printf(': %.1f%%', null_pct) FROM n
          UNION ALL SELECT experiment_id, 'High variability in ' || metric || printf(': CV=%.1f%%', cv_pct) FROM v),
    g AS (SELECT experiment_id, count(*) AS n_warnings, string_agg(t, '; ' ORDER BY t) AS warnings FROM w GROUP BY 1)
    SELECT e.experiment_id,
           CASE WHEN c.found IS NULL THEN 'failed' WHEN coalesce(g.n_warnings, 0) > 0 THEN 'warnings' ELSE 'passed' END AS quality,
           coalesce(g.n_warnings, 0) AS n_warnings, coalesce(g.warnings, '') AS warnings,
           CASE WHEN c.found IS NULL THEN 'failed' WHEN coalesce(g.n_warnings, 0) > 0 THEN 'completed_with_warnings'
                ELSE 'completed' END AS status
    FROM e LEFT JOIN c ON e.experiment_id = c.experiment_id LEFT JOIN g ON e.experiment_id = g.experiment_id""")
def quality_verdict(spark, sf):
    """G-4: verdict and warning texts per experiment from G-1, G-2 and G-3; some
    experiments lack a required metric, some have no metric at all."""
    g = ad.gappy(spark, sf)
    names = F.array_compact(F.array(F.lit("cpu_cores"), F.lit("mem_bytes"), F.when(F.col("load_users") >= 30, F.lit("requests_per_second"))))
    has = g.where(~((F.col("load_users") == 75) & (F.col("replica_count") == 4)))
    comp = qa.completeness(has.select("experiment_id", F.explode(names).alias("metric")), ["experiment_id"])
    v = qa.quality_verdict(comp, qa.null_share(g, ["experiment_id"], _NULL_COLS, max_pct=_VERDICT_NULL),
                           qa.stability_cv(g, ["experiment_id"], _CV_COLS, max_pct=_VERDICT_CV), ["experiment_id"])
    return v.select("experiment_id", "quality", F.col("n_warnings").cast("long").alias("n_warnings"),
                    F.array_join(F.array_sort("warnings"), "; ").alias("warnings"), "status")


@register("freshness", adapters=["samples", "containers"], floats=["age_seconds"], sql=f"""
    SELECT w.service, c.service IS NOT NULL AS is_valid,
           CASE WHEN c.service IS NULL THEN 'No deployment information found' ELSE '' END AS issues,
           array_to_string(list_filter([
             CASE WHEN coalesce(p.ncpu, 0) = 0 THEN 'No CPU metrics data' END,
             CASE WHEN coalesce(p.nmem, 0) = 0 THEN 'No memory metrics data' END,
             CASE WHEN (epoch_us(TIMESTAMP '2024-01-30 23:45:00') - epoch_us(p.last_ts)) / 1e6 > 3600 THEN 'Data is stale' END],
             lambda x: x IS NOT NULL), '; ') AS warnings,
           (epoch_us(TIMESTAMP '2024-01-30 23:45:00') - epoch_us(p.last_ts)) / 1e6 AS age_seconds
    FROM ({_WANTED_SQL}) w
    LEFT JOIN (SELECT DISTINCT service FROM containers WHERE service <> 'signup') c ON w.service = c.service
    LEFT JOIN (SELECT service, count(*) FILTER (WHERE metric = 'cpu_cores') AS ncpu,
                      count(*) FILTER (WHERE metric = 'mem_bytes') AS nmem, max(ts) AS last_ts
               FROM samples WHERE NOT (metric = 'mem_bytes' AND service = 'view') GROUP BY service) p
      ON w.service = p.service""")
def freshness(spark, sf):
    """G-5: inventory / metrics / staleness checks per requested service."""
    inv = ad.containers(spark, sf).where(F.col("service") != "signup")
    s = ad.samples(spark, sf).where(~((F.col("metric") == "mem_bytes") & (F.col("service") == "view")))
    f = qa.freshness(_wanted(spark, sf), inv, s, "2024-01-30 23:45:00")
    return f.select("service", "is_valid", F.array_join("issues", "; ").alias("issues"),
                    F.array_join("warnings", "; ").alias("warnings"), "age_seconds")
