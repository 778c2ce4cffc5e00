"""Registered queries: alert rules, drift, feature selection, signal stability, grants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantities import parse_cpu as parse_cpu_col
from ..operators import alerts, allocation, drift, imputation, intervals, isolation, reduction, selection, settling
from ..sources import adapters as ad
from ..streaming import alerts as stream
from ..streaming import sessions
from ..streaming import streams as st
from .registry import register
from .sqlfn import parse_cpu

STALE = "30 minutes"


def _cpu_percent(events):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(F.col("event_type").alias("service"), "ts", k.cast("double").alias("value"))


_ALERTS_SQL = """
    WITH v AS (SELECT event_type AS service, ts, max(CAST(k AS DOUBLE)) AS value FROM ev WHERE k IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
    n AS (
      SELECT *, lag(ts) OVER w AS before, lag(value) OVER w AS value_before, lead(ts) OVER w AS after, lead(value) OVER w AS value_after
      FROM v WINDOW w AS (PARTITION BY service ORDER BY ts)),
    a AS (
      SELECT *, CASE WHEN value_before > 80 AND ts <= before + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins,
             CASE WHEN after IS NULL OR after > ts + INTERVAL 30 MINUTE THEN ts + INTERVAL 30 MINUTE WHEN NOT value_after > 80 THEN after END AS until
      FROM n WHERE value > 80),
    i AS (SELECT *, sum(begins) OVER (PARTITION BY service ORDER BY ts) AS island FROM a),
    c AS (SELECT service, min(ts) AS since, max(until) AS until, max(until) > min(ts) + INTERVAL 5 MINUTE AS fired FROM i GROUP BY service, island)
    SELECT service, 'pending' AS state, since AS "at", since FROM c
    UNION ALL SELECT service, 'firing', since + INTERVAL 5 MINUTE, since FROM c WHERE fired
    UNION ALL SELECT service, CASE WHEN fired THEN 'resolved' ELSE 'inactive' END, until, since FROM c"""


def _events_of(df):
    return df.select("service", "state", F.col("at").cast("timestamp_ntz").alias("at"), F.col("since").cast("timestamp_ntz").alias("since"))


@register("alert_events", adapters=["ev"], sql=_ALERTS_SQL)
def alert_events(spark, sf):
    """Cpu over 80 % for 5 minutes, per service."""
    return _events_of(alerts.alert_events(_cpu_percent(ad.table(spark, sf, "events")), stale=STALE))


@register("stream_alert_events", adapters=["ev"], sql=_ALERTS_SQL)
def stream_alert_events(spark, sf):
    """The same rule over a file stream, with keyed state and event-time timers."""
    events = f"{sf}/events.parquet"
    upto = spark.read.parquet(events).agg(F.max("ts").cast("timestamp")).first()[0]
    return _events_of(stream.run_alerts(_cpu_percent(st.table_stream(spark, events)), upto, stale=STALE))


_SPLIT = "2024-01-16"


@register("drift", adapters=["samples"], floats=["ks", "ks_p", "psi"], sql=f"""
    WITH s AS (
      SELECT service, metric AS feature, value, CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 1 ELSE 0 END AS ref FROM samples WHERE value IS NOT NULL),
    c AS (SELECT service, feature, value, CAST(sum(ref) AS BIGINT) AS r, CAST(sum(1 - ref) AS BIGINT) AS c FROM s GROUP BY 1, 2, 3),
    z AS (SELECT service, feature, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(c) AS BIGINT) AS n_cur FROM c GROUP BY 1, 2),
    u AS (
      SELECT service, feature, n_ref, n_cur, CAST(sum(r) OVER w AS BIGINT) AS ur, CAST(sum(c) OVER w AS BIGINT) AS uc
      FROM c JOIN z USING (service, feature) WINDOW w AS (PARTITION BY service, feature ORDER BY value)),
    k AS (
      SELECT service, feature, n_ref, n_cur, max(abs(ur * n_cur - uc * n_ref)) / (n_ref::DOUBLE * n_cur::DOUBLE) AS ks FROM u GROUP BY 1, 2, 3, 4),
    e AS (
      SELECT service, feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM s WHERE ref = 1 GROUP BY 1, 2),
    b AS (
      SELECT service, feature, len(list_filter(edges, lambda x: x < value)) AS bin, sum(r) AS r, sum(c) AS c
      FROM c JOIN e USING (service, feature) GROUP BY 1, 2, 3),
    p AS (
      SELECT service, feature, sum((q - p) * ln(q / p)) AS psi FROM (
        SELECT service, feature, greatest(c / n_cur::DOUBLE, {drift.PSI_FLOOR}) AS q, greatest(r / n_ref::DOUBLE, {drift.PSI_FLOOR}) AS p
        FROM b JOIN z USING (service, feature)) GROUP BY 1, 2),
    t AS (
      SELECT *, ks * ks * (n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS square FROM k JOIN p USING (service, feature)),
    f AS (
      SELECT *, CASE WHEN square < {drift.SMALL_LAMBDA ** 2} THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, {drift.TERMS + 1}),
               lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * square))))) END AS ks_p FROM t)
    SELECT service, feature, n_ref, n_cur, ks, ks_p, psi, ks_p < {drift.ALPHA} AS drifted,
           CASE WHEN psi >= {drift.PSI_SIGNIFICANT} THEN 'significant' WHEN psi >= {drift.PSI_MODERATE} THEN 'moderate' ELSE 'stable' END AS level
    FROM f""")
def drift_report(spark, sf):
    """Two halves of the period compared per service and metric."""
    s = ad.samples(spark, sf).withColumnRenamed("metric", "feature")
    first = F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz")
    return drift.drift(s.where(first), s.where(~first))


FEATURES = ["cpu_cores_value", "mem_bytes_value", "net_tx_bytes_value", "node_cpu_util_value", "node_mem_util_value", "pod_restarts_value"]
TARGET = "net_rx_bytes_value"
PAIRS = [(f, TARGET) for f in FEATURES] + [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


def _bin(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE "
            f"CAST(least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * {selection.BINS}), {selection.BINS - 1}) AS INTEGER) END END")


_INFO_SQL = f"""
    binned AS (SELECT {', '.join(f'{_bin(c)} AS {c}' for c in [*FEATURES, TARGET])} FROM experiments),
    joint AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, count(*) AS n FROM binned WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4" for a, b in PAIRS)}),
    shares AS (
      SELECT a, b, n, CAST(sum(n) OVER (PARTITION BY a, b, x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY a, b, y) AS DOUBLE) AS ny,
             CAST(sum(n) OVER (PARTITION BY a, b) AS DOUBLE) AS total FROM joint),
    info AS (
      SELECT a, b, CAST(max(total) AS BIGINT) AS n, greatest(sum(n / total * ln(n * total / (nx * ny))), 0.0) AS mutual_info FROM shares GROUP BY a, b)"""


@register("mutual_information", adapters=["experiments"], floats=["mutual_info"], sql=f"WITH {_INFO_SQL} SELECT a, b, n, mutual_info FROM info")
def mutual_information(spark, sf):
    """All pairs of features, and each with the target, from one joint aggregate."""
    return selection.mutual_information(ad.experiments(spark, sf), PAIRS)


@register("selected_features", adapters=["experiments"], floats=["variance", "mutual_info"], sql=f"""
    WITH {_INFO_SQL},
    spread AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, coalesce(var_samp({f}), 0.0) AS variance FROM experiments" for f in FEATURES)}),
    corrs AS ({' UNION ALL '.join(f"SELECT '{a}' AS f, '{b}' AS g, abs(corr({a}, {b})) AS r FROM experiments" for a in FEATURES for b in FEATURES if a != b)}),
    ranked AS (
      SELECT feature, variance, coalesce(mutual_info, 0.0) AS mutual_info,
             row_number() OVER (ORDER BY round(coalesce(mutual_info, 0.0), 9) DESC, feature) AS place
      FROM spread LEFT JOIN info ON info.a = feature AND info.b = '{TARGET}'),
    passing AS (
      SELECT * FROM ranked WHERE variance >= {selection.VARIANCE_LIMIT} AND mutual_info >= {selection.INFORMATION_LIMIT}),
    like_better AS (
      SELECT p.feature, arg_min(q.feature, q.place) AS kept_as FROM passing p JOIN passing q ON q.place < p.place
      JOIN corrs c ON c.f = p.feature AND c.g = q.feature AND c.r >= {selection.CORRELATION_LIMIT} GROUP BY p.feature)
    SELECT r.feature, variance, mutual_info,
           CASE WHEN variance < {selection.VARIANCE_LIMIT} THEN 'low variance' WHEN mutual_info < {selection.INFORMATION_LIMIT} THEN 'low information'
                WHEN kept_as IS NOT NULL THEN 'redundant' ELSE 'kept' END AS reason, kept_as
    FROM ranked r LEFT JOIN like_better USING (feature)""")
def selected_features(spark, sf):
    """Variance, information and redundancy of the features of the experiments."""
    return selection.select_features(ad.experiments(spark, sf), FEATURES, TARGET)


@register("signal_stability", adapters=["strategy_samples"], floats=["final_value", "settling_seconds", "resource_efficiency"], sql=f"""
    WITH d AS (
      SELECT experiment_id, ts, seq, sign(replica_count - lag(replica_count) OVER w) AS d FROM strategy_samples
      WHERE replica_count IS NOT NULL WINDOW w AS (PARTITION BY experiment_id ORDER BY ts, seq)),
    t AS (SELECT experiment_id, d <> lag(d) OVER (PARTITION BY experiment_id ORDER BY ts, seq) AS t FROM d WHERE d <> 0),
    o AS (SELECT experiment_id, count(*) FILTER (t) AS n FROM t GROUP BY 1),
    f AS (
      SELECT experiment_id, arg_max(cpu_utilization, (ts, seq)) AS final_value, min(ts) AS first, max(ts) AS last
      FROM strategy_samples WHERE cpu_utilization IS NOT NULL GROUP BY 1),
    s AS (
      SELECT s.experiment_id, ts, seq, abs(cpu_utilization - final_value) > abs(final_value) * {settling.BAND} AS outside
      FROM strategy_samples s JOIN f USING (experiment_id) WHERE cpu_utilization IS NOT NULL),
    l AS (SELECT experiment_id, max((ts, seq)) FILTER (outside) AS out_at FROM s GROUP BY 1),
    g AS (SELECT s.experiment_id, min(ts) AS settled_at FROM s JOIN l USING (experiment_id) WHERE out_at IS NULL OR (ts, seq) > out_at GROUP BY 1),
    e AS (SELECT experiment_id, sum(cpu_cores * cpu_utilization * elapsed_hours) / sum(cpu_cores * elapsed_hours) AS resource_efficiency FROM strategy_samples GROUP BY 1)
    SELECT e.experiment_id, coalesce(o.n, 0) AS oscillation_count, final_value, settled_at,
           (epoch_us(settled_at) - epoch_us(first)) / 1e6 AS settling_seconds, resource_efficiency
    FROM e LEFT JOIN o USING (experiment_id) LEFT JOIN f USING (experiment_id) LEFT JOIN g USING (experiment_id)""")
def signal_stability(spark, sf):
    """Reversals of the replica count, settling of the load, efficiency per experiment."""
    return settling.signal_stability(ad.strategy_samples(spark, sf))


PRIORITY = ["purchase", "signup", "view"]


@register("granted_requests", adapters=["containers"], sql=f"""
    WITH r AS (SELECT service, container AS name, CAST(floor({parse_cpu('cpu_request')} * 1000 + 0.5) AS BIGINT) AS requested FROM containers),
    cap AS (SELECT CAST(sum(requested) AS BIGINT) * {allocation.CAP_PCT} // 100 AS cap FROM r),
    p AS (SELECT *, CASE service {' '.join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(PRIORITY))} ELSE {len(PRIORITY) + 1} END AS priority FROM r),
    b AS (
      SELECT *, CAST(coalesce(sum(requested) OVER (ORDER BY priority, service, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM p),
    g AS (SELECT *, least(requested, greatest(cap - before, 0)) AS granted FROM b, cap)
    SELECT service, name, requested, CAST(priority AS BIGINT) AS priority, CAST(granted AS BIGINT) AS granted,
           CASE WHEN granted = requested THEN 'granted' WHEN granted > 0 THEN 'partial' ELSE 'refused' END AS outcome
    FROM g""")
def granted_requests(spark, sf):
    """Cpu requests (millicores) granted under 80 % of a cluster that has just what is
    requested."""
    r = ad.containers(spark, sf).select(
        "service", F.col("container").alias("name"), F.floor(parse_cpu_col(F.col("cpu_request")) * 1000 + 0.5).cast("long").alias("requested"))
    return allocation.grants(r, r.agg(F.sum("requested")).first()[0] or 0, priorities=PRIORITY)


COMPONENT_COLUMNS = ["cpu_cores_value", "node_cpu_util_value"]


@register("principal_components", adapters=["experiments"], floats=["variance", "share"], sql="""
    WITH r AS (SELECT abs(corr(cpu_cores_value, node_cpu_util_value)) AS r FROM experiments)
    SELECT 1 AS component, 1 + r AS variance, (1 + r) / 2 AS share FROM r UNION ALL SELECT 2, 1 - r, (1 - r) / 2 FROM r""")
def principal_components(spark, sf):
    """Components of two standardised columns, whose variances have a closed form."""
    return reduction.principal_components(ad.experiments(spark, sf), COMPONENT_COLUMNS).table(spark)


@register("samples_after_errors", floats=["total"], sql="""
    SELECT e.event_id AS error_id, count(*) AS n, sum(s.value) AS total
    FROM events e JOIN events s ON s.ts >= e.ts AND s.ts < e.ts + to_minutes(CAST(1 + e.event_id % 60 AS INTEGER))
    WHERE e.event_type = 'error' GROUP BY 1""")
def samples_after_errors(spark, sf):
    """All events in the minutes after each error, by an interval join that adds them up."""
    e = ad.table(spark, sf, "events")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (1 + F.col("event_id") % 60).cast("int"))
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("start"), (F.col("ts") + minutes).alias("end"))
    out = intervals.interval_join(e.select("ts", "value"), spans, value="value")
    return out.groupBy("error_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


_SESSIONS_SQL = """
    WITH s AS (SELECT event_type AS service, ts, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
    b AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS begins FROM s WINDOW w AS (PARTITION BY service ORDER BY ts)),
    i AS (SELECT *, sum(begins) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM b)
    SELECT service, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS n, sum(value) AS total, max(value) AS peak
    FROM i GROUP BY service, session"""


def _plain(df):
    return df.select("service", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                     F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", "total", "peak")


@register("event_sessions", floats=["total", "peak"], sql=_SESSIONS_SQL)
def event_sessions(spark, sf):
    """Bursts of events per type."""
    return _plain(sessions.batch_sessions(ad.table(spark, sf, "events").withColumnRenamed("event_type", "service")))


@register("stream_event_sessions", floats=["total", "peak"], sql=_SESSIONS_SQL)
def stream_event_sessions(spark, sf):
    """The same bursts from a file stream with session state."""
    events = f"{sf}/events.parquet"
    upto = spark.read.parquet(events).agg(F.max("ts").cast("timestamp")).first()[0]
    return _plain(sessions.run_sessions(st.table_stream(spark, events).withColumnRenamed("event_type", "service"), upto))


@register("isolation_scores")
def isolation_scores(spark, sf):
    """Outlier scores of the experiment rows; seeded, so checked by the tests."""
    rows = ad.experiments(spark, sf)
    forest = isolation.fit_isolation(rows, ["cpu_cores_value", "mem_bytes_value", "pod_restarts_value"])
    return isolation.isolation_scores(rows, forest).select("event_id", "isolation_score")


IMPUTE_ROUNDS = 3


def _impute_sql() -> str:
    """Rounds of fits of two columns on each other, each with the fills of the round before."""
    out = """
    x AS (
      SELECT event_id, net_rx_bytes_value AS a, cpu_cores_value - lag(cpu_cores_value) OVER (PARTITION BY experiment_id ORDER BY idx) AS b FROM experiments),
    y0 AS (SELECT event_id, a, b, coalesce(a, avg(a) OVER ()) AS ya, coalesce(b, avg(b) OVER ()) AS yb FROM x)"""
    for k in range(IMPUTE_ROUNDS):
        out += f""",
    f{k} AS (
      SELECT regr_slope(ya, yb) FILTER (a IS NOT NULL) AS sa, regr_intercept(ya, yb) FILTER (a IS NOT NULL) AS ca,
             regr_slope(yb, ya) FILTER (b IS NOT NULL) AS sb, regr_intercept(yb, ya) FILTER (b IS NOT NULL) AS cb FROM y{k}),
    y{k + 1} AS (SELECT event_id, a, b, coalesce(a, sa * yb + ca) AS ya, coalesce(b, sb * ya + cb) AS yb FROM y{k}, f{k})"""
    return f"""WITH {out}
    SELECT event_id, coalesce(a, round(ya, 4)) AS net_rx_bytes_value, coalesce(b, round(yb, 9)) AS cpu_change FROM y{IMPUTE_ROUNDS}"""


@register("iterative_impute", adapters=["experiments"], floats=["net_rx_bytes_value", "cpu_change"], sql=_impute_sql())
def iterative_impute(spark, sf):
    """Received bytes (missing in a fifth of the rows) and the change of cpu (missing in
    an experiment's first row) filled from each other."""
    e = ad.experiments(spark, sf)
    before = F.lag("cpu_cores_value").over(Window.partitionBy("experiment_id").orderBy("idx"))
    x = e.select("event_id", F.col("net_rx_bytes_value").cast("double").alias("a"), (F.col("cpu_cores_value") - before).alias("b"))
    y = imputation.iterative_impute(x.select("*", F.col("a").alias("ya"), F.col("b").alias("yb")), ["ya", "yb"], IMPUTE_ROUNDS)
    return y.select("event_id", F.coalesce("a", F.round("ya", 4)).alias("net_rx_bytes_value"), F.coalesce("b", F.round("yb", 9)).alias("cpu_change"))
