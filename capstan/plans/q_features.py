"""Registered queries: derived metrics and features (F-*) and splits (P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive as dv
from ..operators import features as fe
from ..operators import scaling as sc
from ..operators import splits as sp
from ..operators import targets as tg
from ..operators.windows import chunked_pass
from ..sources import adapters as ad
from .registry import register

W = "WINDOW w AS (PARTITION BY experiment_id ORDER BY idx)"
P = "PARTITION BY experiment_id"


def _lagd(c: str) -> str:
    return f"coalesce({c} - lag({c}) OVER w, 0.0)"


@register("derived_metrics", adapters=["experiments"],
          floats=["network_activity_rate_value", "net_rx_bytes_value", "net_tx_bytes_value",
                  "processing_intensity_value", "service_stability_value", "resource_pressure_value"], sql=f"""
    SELECT event_id, experiment_id, idx,
           CASE WHEN lag(idx) OVER w IS NULL THEN 0.0
                WHEN net_rx_bytes_value IS NULL OR net_tx_bytes_value IS NULL THEN {_lagd('cpu_cores_value')}
                ELSE coalesce((net_rx_bytes_value - lag(net_rx_bytes_value) OVER w)
                              + (net_tx_bytes_value - lag(net_tx_bytes_value) OVER w), {_lagd('cpu_cores_value')})
           END AS network_activity_rate_value,
           coalesce(net_rx_bytes_value, cpu_cores_value * 1000.0) AS net_rx_bytes_value,
           coalesce(net_tx_bytes_value, mem_bytes_value * 0.1) AS net_tx_bytes_value,
           cpu_cores_value AS processing_intensity_value,
           1.0 / (1.0 + greatest({_lagd('pod_restarts_value')}, 0.0)) AS service_stability_value,
           ((CASE WHEN mc > 0 THEN cpu_cores_value / mc ELSE cpu_cores_value END)
            + (CASE WHEN mm > 0 THEN mem_bytes_value / mm ELSE mem_bytes_value END)) / 2.0 AS resource_pressure_value
    FROM (SELECT *, max(cpu_cores_value) OVER ({P}) AS mc, max(mem_bytes_value) OVER ({P}) AS mm FROM experiments) e
    {W}""")
def derived_metrics(spark, sf):
    """F-1..F-5: network activity, network substitute (missing only),
    processing intensity, service stability, resource pressure."""
    e = dv.derived_metrics(ad.experiments(spark, sf))
    return e.select("event_id", "experiment_id", "idx", "network_activity_rate_value", "net_rx_bytes_value",
                    "net_tx_bytes_value", "processing_intensity_value", "service_stability_value",
                    "resource_pressure_value")


@register("diff_features", adapters=["experiments"],
          floats=["replica_change", "load_change", "cpu_cores_value_delta", "node_mem_util_value_delta"], sql=f"""
    SELECT event_id, {_lagd('replica_count_value')} AS replica_change,
           {_lagd('CAST(load_users AS DOUBLE)')} AS load_change,
           {_lagd('cpu_cores_value')} AS cpu_cores_value_delta,
           {_lagd('node_mem_util_value')} AS node_mem_util_value_delta,
           CAST({_lagd('replica_count_value')} > 0 AS INTEGER) AS replica_scaling_up,
           CAST({_lagd('CAST(load_users AS DOUBLE)')} > 0 AS INTEGER) AS load_increasing
    FROM experiments {W}""")
def diff_features(spark, sf):
    """F-6 + F-7: row differences and change flags."""
    e = ad.experiments(spark, sf).withColumn("load_users_d", F.col("load_users").cast("double"))
    e = dv.diff_features(e, ["replica_count_value", "load_users_d", "cpu_cores_value", "node_mem_util_value"],
                         names=["replica_change", "load_change", "cpu_cores_value_delta", "node_mem_util_value_delta"])
    e = dv.change_flags(e, [("replica_change", "replica_scaling_up"), ("load_change", "load_increasing")])
    return e.select("event_id", "replica_change", "load_change", "cpu_cores_value_delta", "node_mem_util_value_delta",
                    "replica_scaling_up", "load_increasing")


@register("resample", adapters=["gappy"], floats=["cpu_cores_value", "mem_bytes_value"], sql="""
    WITH a AS (SELECT experiment_id, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bin_s,
                      avg(cpu_cores_value) AS cpu_cores_value, avg(mem_bytes_value) AS mem_bytes_value
               FROM gappy GROUP BY 1, 2),
    g AS (SELECT experiment_id, unnest(generate_series(min(bin_s), max(bin_s), 3600)) AS bin_s FROM a GROUP BY 1)
    SELECT g.experiment_id, g.bin_s, a.cpu_cores_value, a.mem_bytes_value, make_timestamp(g.bin_s * 1000000) AS bin_start
    FROM g LEFT JOIN a ON g.experiment_id = a.experiment_id AND g.bin_s = a.bin_s""")
def resample(spark, sf):
    """F-8: hourly means per experiment, empty hours kept as NULL rows."""
    out = dv.resample(ad.gappy(spark, sf), ["cpu_cores_value", "mem_bytes_value"], 3600)
    return out.select("experiment_id", "bin_s", "cpu_cores_value", "mem_bytes_value",
                      F.col("bin_start").cast("timestamp_ntz").alias("bin_start"))


@register("fill_gaps", adapters=["gappy"], floats=["cpu_cores_value"], sql=f"""
    SELECT event_id, experiment_id, idx,
           CASE WHEN v IS NOT NULL THEN v
                WHEN pv IS NOT NULL AND nv IS NOT NULL THEN
                     (CASE WHEN np = pp THEN pv ELSE pv + (nv - pv) * (idx - pp) / (np - pp) END)
                WHEN pv IS NOT NULL THEN pv WHEN nv IS NOT NULL THEN nv ELSE 0.0 END AS cpu_cores_value
    FROM (SELECT *, cpu_cores_value AS v,
                 last_value(cpu_cores_value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
                 last_value(CASE WHEN cpu_cores_value IS NOT NULL THEN idx END IGNORE NULLS)
                   OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
                 first_value(cpu_cores_value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
                 first_value(CASE WHEN cpu_cores_value IS NOT NULL THEN idx END IGNORE NULLS)
                   OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
          FROM gappy {W}) g""")
def fill_gaps(spark, sf):
    """F-9: linear interpolation + fills on the gappy cpu series."""
    g = ad.gappy(spark, sf).select("event_id", "experiment_id", "idx", "cpu_cores_value")
    return dv.fill_gaps(g, ["cpu_cores_value"])


@register("pattern_features", adapters=["experiments"], floats=["hour_pattern", "growth_trend"], sql=f"""
    SELECT event_id, CAST(idx AS INTEGER) AS time_idx,
           0.5 + 0.3 * sin(2 * pi() * (24 * (idx / (n - 1)) - 8) / 24) AS hour_pattern,
           1 + 0.3 * (idx / (n - 1)) AS growth_trend
    FROM (SELECT *, CASE WHEN count(*) OVER ({P}) = 1 THEN NULL ELSE count(*) OVER ({P}) END AS n FROM experiments) e""")
def pattern_features(spark, sf):
    """F-23: time index, daily pattern and growth trend."""
    return dv.pattern_features(ad.experiments(spark, sf)).select("event_id", "time_idx", "hour_pattern",
                                                                 "growth_trend")


_LAGS = fe.LAGS


@register("lag_features", adapters=["gappy"],
          floats=[f"node_cpu_util_value_lag{k}" for k in _LAGS] + [f"cpu_cores_value_lag{k}" for k in _LAGS]
          + ["cpu_cores_value_lag_1", "mem_bytes_value_lag_1"], sql=f"""
    SELECT event_id,
           {", ".join(f"coalesce(lag(node_cpu_util_value, {k}) OVER w, 0.0) AS node_cpu_util_value_lag{k}"
                      for k in _LAGS)},
           {", ".join(f"lag(cpu_cores_value, {k}) OVER w AS cpu_cores_value_lag{k}" for k in _LAGS)},
           coalesce(lag(cpu_cores_value) OVER w, cpu_cores_value) AS cpu_cores_value_lag_1,
           coalesce(lag(mem_bytes_value) OVER w, mem_bytes_value) AS mem_bytes_value_lag_1
    FROM gappy {W}""")
def lag_features(spark, sf):
    """F-10 (0-filled and NULL variants) and F-11 (self-filled lag 1)."""
    g = chunked_pass(ad.gappy(spark, sf), dv.KEYS, "idx", [
        fe.lag_spec(["node_cpu_util_value"], fill=0.0), fe.lag_spec(["cpu_cores_value"], fill=None),
        fe.self_fill_spec(["cpu_cores_value", "mem_bytes_value"])])
    return g.select("event_id", *[f"node_cpu_util_value_lag{k}" for k in _LAGS],
                    *[f"cpu_cores_value_lag{k}" for k in _LAGS], "cpu_cores_value_lag_1", "mem_bytes_value_lag_1")


def _roll_sql(c: str, windows, stats, min_periods=None, std_fill=None) -> list[tuple[str, str]]:
    fn = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
          "median": "quantile_cont({c}, 0.5)"}
    out = []
    for n in windows:
        frame = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        need = n if min_periods is None else min_periods
        for s in stats:
            e = f"CASE WHEN count({c}) OVER {frame} >= {need} THEN {fn[s].format(c=c)} OVER {frame} END"
            if s == "std" and std_fill is not None:
                e = f"coalesce({e}, {std_fill})"
            out.append((e, f"{c}_roll{n}_{s}"))
    return out


_FULL = _roll_sql("cpu_cores_value", fe.FULL_WINDOWS, ("mean", "std", "min", "max", "median"))
_MIN1 = _roll_sql("node_cpu_util_value", fe.MIN1_WINDOWS, ("mean", "std"), 1, 0.0)


@register("rolling", adapters=["gappy"], floats=[n for _, n in _FULL + _MIN1], sql=f"""
    SELECT event_id, {", ".join(f"{e} AS {n}" for e, n in _FULL + _MIN1)} FROM gappy {W}""")
def rolling(spark, sf):
    """F-12: full-window statistics incl. rolling median, and the min-1
    variant with std NULL -> 0."""
    g = chunked_pass(ad.gappy(spark, sf), dv.KEYS, "idx", [
        fe.rolling_spec(["cpu_cores_value"]),
        fe.rolling_spec(["node_cpu_util_value"], fe.MIN1_WINDOWS, ("mean", "std"), min_periods=1, std_fill=0.0)])
    return g.select("event_id", *[n for _, n in _FULL + _MIN1])


@register("rolling_across_split", adapters=["gappy"], floats=[n for _, n in _MIN1], sql=f"""
    SELECT event_id, CASE WHEN idx < floor(count(*) OVER ({P}) * 0.8) THEN 'train' ELSE 'test' END AS split,
           {", ".join(f"{e} AS {n}" for e, n in _MIN1)} FROM gappy {W}""")
def rolling_across_split(spark, sf):
    """F-13: test rows see the train tail - rolling on the whole ordered
    series, split labels added afterwards (trailing frames never look ahead)."""
    g = ad.gappy(spark, sf)
    g = fe.rolling(g, ["node_cpu_util_value"], fe.MIN1_WINDOWS, ("mean", "std"), min_periods=1, std_fill=0.0)
    g = sp.time_split(g)
    return g.select("event_id", "split", *[n for _, n in _MIN1])


@register("stat_features", adapters=["gappy"],
          floats=["cpu_cores_value_zscore", "cpu_cores_value_pct_rank", "cpu_cores_value_x_replica_count_value",
                  "node_cpu_util_value_x_node_mem_util_value", "clipped_cpu", "imputed_cpu"], sql=f"""
    WITH g AS (SELECT *, avg(cpu_cores_value) OVER ({P}) AS m, stddev_samp(cpu_cores_value) OVER ({P}) AS s,
                      quantile_cont(cpu_cores_value, 0.25) OVER ({P}) AS q1,
                      quantile_cont(cpu_cores_value, 0.75) OVER ({P}) AS q3,
                      quantile_cont(cpu_cores_value, 0.5) OVER ({P}) AS med,
                      count(cpu_cores_value) OVER ({P}) AS nn FROM gappy),
    r AS (SELECT experiment_id, cpu_cores_value,
                 (rank() OVER (PARTITION BY experiment_id ORDER BY cpu_cores_value)
                  + (count(*) OVER (PARTITION BY experiment_id, cpu_cores_value) - 1) / 2.0) AS rk
          FROM gappy WHERE cpu_cores_value IS NOT NULL)
    SELECT g.event_id,
           CASE WHEN s = 0 THEN NULL ELSE (g.cpu_cores_value - m) / s END AS cpu_cores_value_zscore,
           (SELECT any_value(rk) FROM r WHERE r.experiment_id = g.experiment_id
              AND r.cpu_cores_value = g.cpu_cores_value) / nn AS cpu_cores_value_pct_rank,
           g.cpu_cores_value * replica_count_value AS cpu_cores_value_x_replica_count_value,
           node_cpu_util_value * node_mem_util_value AS node_cpu_util_value_x_node_mem_util_value,
           CASE WHEN g.cpu_cores_value IS NOT NULL THEN least(greatest(g.cpu_cores_value, q1 - 3.0 * (q3 - q1)), q3 + 3.0 * (q3 - q1)) END AS clipped_cpu,
           coalesce(g.cpu_cores_value, med) AS imputed_cpu
    FROM g""")
def stat_features(spark, sf):
    """F-14..F-18: z-score, average-tie percent rank, interactions, IQR clip,
    median imputation (group statistics joined back)."""
    g = ad.gappy(spark, sf)
    base = g.select("event_id", "experiment_id", "cpu_cores_value", "replica_count_value", "node_cpu_util_value",
                    "node_mem_util_value")
    c = "cpu_cores_value"
    d = fe.percent_rank_avg(base, c)
    d = fe.zscore(fe.with_statistics(d, [c]), [c])
    d = fe.interactions(d, [(c, "replica_count_value"), ("node_cpu_util_value", "node_mem_util_value")])
    m = fe.impute_median(fe.clip_outliers(d, [c], names=["clipped_cpu"]), [c], names=["imputed_cpu"])
    return m.select("event_id", "cpu_cores_value_zscore", "cpu_cores_value_pct_rank",
                    "cpu_cores_value_x_replica_count_value", "node_cpu_util_value_x_node_mem_util_value",
                    "clipped_cpu", "imputed_cpu")


def _scale_sql(method: str, c: str) -> tuple[str, str]:
    if method == "robust":
        agg = (f"quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS b, quantile_cont({c}, 0.75) AS d")
        expr = f"({c} - p.b) / (CASE WHEN p.d - p.a = 0 THEN 1.0 ELSE p.d - p.a END)"
    elif method == "standard":
        agg = f"avg({c}) AS b, stddev_pop({c}) AS d"
        expr = f"({c} - p.b) / (CASE WHEN p.d = 0 THEN 1.0 ELSE p.d END)"
    else:
        agg = f"min({c}) AS b, max({c}) AS d"
        expr = f"({c} - p.b) / (CASE WHEN p.d - p.b = 0 THEN 1.0 ELSE p.d - p.b END)"
    return agg, expr


def _scale_query(method: str) -> str:
    agg, expr = _scale_sql(method, "node_cpu_util_value")
    return f"""
    WITH s AS (SELECT *, CASE WHEN idx < floor(count(*) OVER ({P}) * 0.8) THEN 'train' ELSE 'test' END AS split
               FROM experiments),
    p AS (SELECT experiment_id, {agg} FROM s WHERE split = 'train' GROUP BY experiment_id)
    SELECT s.event_id, s.split, {expr} AS node_cpu_util_value_scaled
    FROM s LEFT JOIN p ON s.experiment_id = p.experiment_id"""


def _scaled(spark, sf, method):
    e = sp.time_split(ad.experiments(spark, sf))
    return sc.scale(e, ["node_cpu_util_value"], method, "train").select("event_id", "split",
                                                                         "node_cpu_util_value_scaled")


@register("scale_robust", adapters=["experiments"], floats=["node_cpu_util_value_scaled"],
          sql=_scale_query("robust"))
def scale_robust(spark, sf):
    """F-19 robust scaling fitted on the train rows of each experiment."""
    return _scaled(spark, sf, "robust")


@register("scale_standard", adapters=["experiments"], floats=["node_cpu_util_value_scaled"],
          sql=_scale_query("standard"))
def scale_standard(spark, sf):
    """F-19 standard scaling (population std) fitted on train rows."""
    return _scaled(spark, sf, "standard")


@register("scale_minmax", adapters=["experiments"], floats=["node_cpu_util_value_scaled"],
          sql=_scale_query("minmax"))
def scale_minmax(spark, sf):
    """F-19 min-max scaling fitted on train rows."""
    return _scaled(spark, sf, "minmax")


_YJ = "(CASE WHEN abs({lam}) > 1e-12 THEN (pow(v + 1, {lam}) - 1) / {lam} ELSE ln(v + 1) END)"
_LL = "-count(*) / 2.0 * ln(var_pop(" + _YJ + ")) + ({lam} - 1) * sum(ln(1 + v))"


def _lambda_step(prev: str, step: float) -> str:
    """Best of eleven lambdas around the previous best, per experiment."""
    return f"""SELECT experiment_id, max({{'ll': ll, 'lam': lam}}).lam AS lam FROM (
        SELECT x.experiment_id, b.lam + o.o * {step} AS lam, {_LL.format(lam=f"(b.lam + o.o * {step})")} AS ll
        FROM x JOIN {prev} b ON x.experiment_id = b.experiment_id, (SELECT unnest(range(-5, 6)) AS o) o
        GROUP BY x.experiment_id, b.lam, o.o) s GROUP BY experiment_id"""


@register("power_transform", adapters=["experiments"], floats=["node_mem_util_value", "lam"], sql=f"""
    WITH x AS (SELECT event_id, experiment_id, node_mem_util_value AS v FROM experiments),
    a AS (SELECT experiment_id, max({{'ll': ll, 'lam': lam}}).lam AS lam FROM (
            SELECT experiment_id, g.lam, {_LL.format(lam='g.lam')} AS ll
            FROM x, (SELECT unnest(range(-8, 17)) / 4.0 AS lam) g GROUP BY experiment_id, g.lam) s GROUP BY experiment_id),
    b AS ({_lambda_step('a', 0.05)}), c AS ({_lambda_step('b', 0.01)}),
    t AS (SELECT x.event_id, x.experiment_id, x.v, c.lam, {_YJ.format(lam='c.lam')} AS y FROM x JOIN c ON x.experiment_id = c.experiment_id)
    SELECT event_id, experiment_id, v AS node_mem_util_value, lam,
           round((y - avg(y) OVER p) / (CASE WHEN stddev_pop(y) OVER p = 0 THEN 1.0 ELSE stddev_pop(y) OVER p END), 7)
             AS node_mem_util_value_power
    FROM t WINDOW p AS (PARTITION BY experiment_id)""")
def power_transform(spark, sf):
    """F-20: Yeo-Johnson (maximum-likelihood lambda per experiment) + standardise."""
    e = ad.experiments(spark, sf).select("event_id", "experiment_id", "node_mem_util_value")
    out = sc.power_transform(e, "node_mem_util_value")
    # small differences of large powers: seven decimals agree between engines
    return out.withColumn("node_mem_util_value_power", F.round("node_mem_util_value_power", 7))


@register("regime", adapters=["experiments"], sql=f"""
    SELECT event_id, CASE WHEN cpu_cores_value <= q1 THEN 0 WHEN cpu_cores_value <= q2 THEN 1 ELSE 2 END
             AS cpu_regime_encoded
    FROM (SELECT *, quantile_cont(cpu_cores_value, 0.33) OVER ({P}) AS q1,
                 quantile_cont(cpu_cores_value, 0.67) OVER ({P}) AS q2 FROM experiments) e""")
def regime(spark, sf):
    """F-21: cpu tercile code per experiment."""
    e = fe.regime(ad.experiments(spark, sf), "cpu_cores_value", out="cpu_regime_encoded")
    return e.select("event_id", "cpu_regime_encoded")


@register("sequences", adapters=["experiments"], floats=["target"], sql=f"""
    SELECT experiment_id, idx, seq AS "sequence", target FROM (
      SELECT experiment_id, idx, cpu_cores_value AS target,
             list([cpu_cores_value, node_cpu_util_value]) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seq
      FROM experiments {W}) s
    WHERE len(seq) = 10""")
def sequences(spark, sf):
    """F-22: the previous 10 feature vectors and the next-step target."""
    return fe.sequences(ad.experiments(spark, sf), ["cpu_cores_value", "node_cpu_util_value"],
                        "cpu_cores_value", 10)


@register("future_change_target", adapters=["experiments"], floats=["rel_change", "y_reg"], sql=f"""
    SELECT event_id, rel_change, coalesce(CAST(rel_change > 0.1 AS INTEGER), 0) AS y_class,
           least(greatest(coalesce(rel_change, 0.0), -1.0), 1.0) AS y_reg
    FROM (SELECT event_id, lead(cpu_cores_value) OVER w AS nxt,
                 ((CASE WHEN lead(cpu_cores_value) OVER w = 0 THEN 1e-6 ELSE lead(cpu_cores_value) OVER w END)
                  - (CASE WHEN cpu_cores_value = 0 THEN 1e-6 ELSE cpu_cores_value END))
                 / (CASE WHEN cpu_cores_value = 0 THEN 1e-6 ELSE cpu_cores_value END) AS rel_change
          FROM experiments {W}) t
    WHERE nxt IS NOT NULL""")
def future_change_target(spark, sf):
    """F-24: next-step relative change target (class and clipped regression)."""
    t = tg.future_change_target(ad.experiments(spark, sf))
    return t.select("event_id", "rel_change", "y_class", "y_reg")


@register("buffered_targets", adapters=["experiments"], floats=["cpu_target", "memory_target", "replica_target"],
          sql="""
    SELECT event_id, cpu_cores_value * 1.2 AS cpu_target, mem_bytes_value * 1.15 AS memory_target,
           replica_count_value * 1.0 AS replica_target FROM experiments""")
def buffered_targets(spark, sf):
    """F-25: buffered cpu / memory / replica targets."""
    return tg.buffered_targets(ad.experiments(spark, sf)).select("event_id", "cpu_target", "memory_target",
                                                                 "replica_target")


@register("class_weights", adapters=["experiments"], floats=["weight"], sql=f"""
    WITH t AS (SELECT event_id, coalesce(CAST(((CASE WHEN lead(cpu_cores_value) OVER w = 0 THEN 1e-6
                                                     ELSE lead(cpu_cores_value) OVER w END)
                 - cpu_cores_value) / cpu_cores_value > 0.1 AS INTEGER), 0) AS y_class,
                      lead(cpu_cores_value) OVER w AS nxt
               FROM experiments {W}),
    c AS (SELECT y_class, count(*) AS nc FROM t WHERE nxt IS NOT NULL GROUP BY y_class)
    SELECT t.event_id, t.y_class, (SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * c.nc) AS weight
    FROM t JOIN c ON t.y_class = c.y_class WHERE nxt IS NOT NULL""")
def class_weights(spark, sf):
    """F-26: balanced class weights of the F-24 class target."""
    t = tg.future_change_target(ad.experiments(spark, sf))
    return tg.class_weights(t).select("event_id", "y_class", "weight")


@register("time_split", adapters=["experiments"], sql=f"""
    SELECT event_id, CASE WHEN idx < floor(count(*) OVER ({P}) * 0.8) THEN 'train' ELSE 'test' END AS split
    FROM experiments""")
def time_split(spark, sf):
    """P-1: first 80 % of each experiment is train."""
    return sp.time_split(ad.experiments(spark, sf)).select("event_id", "split")


@register("random_split", adapters=["experiments"], sql=f"""
    SELECT experiment_id, count(*) FILTER (WHERE split = 'train') AS n_train,
           count(*) FILTER (WHERE split = 'test') AS n_test
    FROM (SELECT experiment_id, CASE WHEN row_number() OVER (PARTITION BY experiment_id ORDER BY event_id) - 1
                                          < floor(count(*) OVER ({P}) * 0.8) THEN 'train' ELSE 'test' END AS split
          FROM experiments) s GROUP BY experiment_id""")
def random_split(spark, sf):
    """P-2: seeded hash split; compared with the oracle on the per-experiment
    train / test sizes (the hash order itself is engine specific)."""
    s = sp.random_split(ad.experiments(spark, sf), "event_id")
    return s.groupBy("experiment_id").agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                          F.count_if(F.col("split") == "test").alias("n_test"))


@register("expanding_folds", adapters=["experiments"], sql=f"""
    WITH e AS (SELECT event_id, idx, count(*) OVER ({P}) AS n FROM experiments),
    f AS (SELECT *, unnest(range(0, 3)) AS fold FROM e)
    SELECT event_id, CAST(fold AS INTEGER) AS fold,
           CASE WHEN idx < n - (3 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS role
    FROM f WHERE n // 4 > 0 AND idx < n - (3 - fold) * (n // 4) + (n // 4)""")
def expanding_folds(spark, sf):
    """P-3: three expanding time-series folds."""
    f = sp.expanding_folds(ad.experiments(spark, sf), 3)
    return f.select("event_id", F.col("fold").cast("int").alias("fold"), "role")


@register("contiguous_folds", adapters=["experiments"], sql=f"""
    SELECT event_id, CAST(CASE WHEN idx < (n // 5 + 1) * (n % 5) THEN floor(idx / (n // 5 + 1))
                               ELSE n % 5 + floor((idx - (n // 5 + 1) * (n % 5)) / (n // 5)) END AS INTEGER) AS fold
    FROM (SELECT event_id, idx, count(*) OVER ({P}) AS n FROM experiments) e""")
def contiguous_folds(spark, sf):
    """P-4: unshuffled 5-fold assignment."""
    return sp.contiguous_folds(ad.experiments(spark, sf), 5).select("event_id", "fold")
