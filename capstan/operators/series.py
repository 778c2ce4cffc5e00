"""Metric-query operators on long ``samples`` tables (B-1..B-16).

Series semantics follow the usual metric query language: label matchers,
counter rates with reset handling, aggregation by labels, label-matched
binary operations, histogram quantiles and step-aligned evaluation.  Trailing ranges
are put together from running sums of buckets of time as long as the range, so the work
grows with the rows and not with the rows of a range; where a bucket has more than
``CHUNK_ROWS`` rows, series are scanned in parts of bounded size, whatever their rows'
spread in time (see :mod:`capstan.operators.windows`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, scratch_table
from .windows import CHUNK_ROWS, US, by_chunks_both, dense_position, epoch_us, join_null_safe, last_seen, sum_before


def _label(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.col("labels").getItem(name)


def select_series(df: DataFrame, eq=None, re=None, ne=None, nre=None) -> DataFrame:
    """B-1: ``=``, ``=~`` (anchored regex), ``!=``, ``!~`` label matchers.
    A missing label is the empty string, as in the query language."""
    conds = []
    # For a non-empty value the NULL-as-empty rule is the plain comparison
    # (plus IS NULL for !=), which the parquet scan can evaluate (pushdown).
    for name, v in (eq or {}).items():
        c = _label(df, name)
        conds.append((c == v) if v != "" else F.coalesce(c, F.lit("")) == v)
    for name, v in (ne or {}).items():
        c = _label(df, name)
        conds.append(((c != v) | c.isNull()) if v != "" else F.coalesce(c, F.lit("")) != v)
    for name, v in (re or {}).items():
        conds.append(F.coalesce(_label(df, name), F.lit("")).rlike(f"^(?:{v})$"))
    for name, v in (nre or {}).items():
        conds.append(~F.coalesce(_label(df, name), F.lit("")).rlike(f"^(?:{v})$"))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def rate(df: DataFrame, range_s: int, series=("service",), ts="ts", value="value",
         order=("ts", "seq"), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """B-2: per-second increase of a counter over the trailing ``range_s``
    window ``(t - range, t]`` at each sample, with counter resets (a drop
    counts the new value as the increase).  Only increases between samples
    inside the window count; no extrapolation to the window edges.  Samples
    whose window holds fewer than two samples give no row."""
    series, order, span = list(series), list(order), range_s * US
    d = df.withColumn("_t", epoch_us(ts)).withColumn("_b", F.expr(f"(_t - pmod(_t, {span}L)) div {span}L"))
    per = d.groupBy(*series, "_b").agg(F.count(F.lit(1)).alias("_n"))
    longest = per.groupBy(*series).agg(F.greatest(F.max("_n"), F.count(F.lit(1))).alias("_n"))
    if not longest.where(F.col("_n") > chunk_rows).isEmpty():
        return _rate_in_parts(df, range_s, series, ts, value, order, chunk_rows)
    return _rate_in_buckets(scratch_table(d, "samples"), df.columns, range_s, series, value, order)


def _rate_in_buckets(d: DataFrame, columns, range_s: int, series, value, order) -> DataFrame:
    """B-2 with samples in buckets ``_b`` of the range's length: a window is the rest of
    one bucket after ``t - range`` and the beginning of the next one up to ``t``.  Both
    are running sums, of the next bucket forwards and of the one before backwards, where
    each sample looks in at ``t - range``."""
    order = ["_t", *order, value]
    v = F.col(value)
    ends = d.groupBy(*series, "_b").agg(F.max_by(F.struct(v.alias("v")), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("_end"))
    carry = ends.select(*series, "_b", F.lag("_end").over(Window.partitionBy(*series).orderBy("_b")).alias("_carry"))
    d = join_null_safe(d, maybe_broadcast(carry), [*series, "_b"])
    part = Window.partitionBy(*series, "_b")
    w, upto = part.orderBy(*order), part.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    pv = F.coalesce(F.lag(F.struct(v.alias("v"))).over(w), "_carry")["v"]
    d = d.withColumn("_inc", F.when(pv.isNull(), F.lit(None)).when(v < pv, v).otherwise(v - pv))
    # samples of one instant share the window's end
    d = d.select(*columns, "_b", "_t", "_inc", F.sum("_inc").over(upto).alias("_sum"), F.count("_inc").over(upto).alias("_has"),
                 F.count(F.lit(1)).over(upto).alias("_n"),
                 F.first(F.struct("_inc")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
    samples = d.select(*series, "_b", *order, "_inc", F.lit(1).alias("_kind"))
    probes = d.select(*columns, (F.col("_b") - 1).alias("_b"), (F.col("_t") - range_s * US).alias("_t"), "_sum", "_has", "_n", "_first", F.lit(0).alias("_kind"))
    back = part.orderBy(F.desc("_t"), "_kind", *[F.desc(c) for c in order[1:]]).rowsBetween(Window.unboundedPreceding, 0)
    sample = F.col("_kind") == 1
    u = samples.unionByName(probes, allowMissingColumns=True).select(
        "*", F.sum("_inc").over(back).alias("_sum2"), F.count("_inc").over(back).alias("_has2"), F.count(F.when(sample, 1)).over(back).alias("_n2"),
        F.last(F.when(sample, F.struct("_inc")), ignorenulls=True).over(back).alias("_first2")).where(~sample)
    total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_sum2", F.lit(0.0))
    # the first sample of a window has its predecessor outside
    outside = F.coalesce(F.coalesce("_first2", "_first")["_inc"], F.lit(0.0))
    # a window without an increase between two values has no rate
    inside = F.when(F.col("_has") + F.col("_has2") > 0, total - outside)
    return u.where(F.col("_n") + F.col("_n2") >= 2).select(*columns, (inside / float(range_s)).alias("rate"))


def _rate_in_parts(df: DataFrame, range_s: int, series, ts, value, order, chunk_rows: int) -> DataFrame:
    """B-2 for long series: increases are summed up along the series, and each
    sample looks up the running sum at the first sample of its window, found as
    the one after the last sample at or before ``t - range``.  The window may
    span any number of parts."""
    p = dense_position(df.withColumn("_t", epoch_us(ts)), series, order, "_p", chunk_rows)

    def steps(d, parts):
        w = Window.partitionBy(*parts).orderBy("_p")
        v, pv, nv = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        return d.withColumn("_inc", F.when(pv.isNull(), F.lit(0.0)).when(v < pv, v).otherwise(v - pv)) \
                .withColumn("_next", F.when(nv < v, nv).otherwise(nv - v)) \
                .withColumn("_has", (v.isNotNull() & pv.isNotNull()).cast("long"))

    p = sum_before(by_chunks_both(p, series, "_p", 1, steps, chunk_rows), series, ["_p"], "_inc", "_before", chunk_rows)
    p = sum_before(p, series, ["_p"], "_has", "_had", chunk_rows)
    p = p.withColumn("_sum", F.col("_before") + F.coalesce("_inc", F.lit(0.0)))
    # samples of one instant share the window's end
    ends = p.groupBy(*series, "_t").agg(F.max(F.struct("_p", "_sum", (F.col("_had") + F.col("_has")).alias("_n"))).alias("_end"))
    p = join_null_safe(p, ends, [*series, "_t"])
    samples = p.select(*series, F.col("_t").alias("_at"), F.lit(0).alias("_kind"), F.col("_p").alias("_o"),
                       F.struct((F.col("_sum") + F.coalesce("_next", F.lit(0.0))).alias("s"), F.col("_p").alias("p"),
                                (F.col("_had") + F.col("_has")).alias("n")).alias("_mark"))
    probes = p.select(*df.columns, "_end", (F.col("_t") - range_s * US).alias("_at"), F.lit(1).alias("_kind"), F.col("_p").alias("_o"))
    u = samples.unionByName(probes, allowMissingColumns=True)
    found = last_seen(u, series, ["_at", "_kind", "_o"], "_mark", "_got", chunk_rows).where(F.col("_kind") == 1)
    n = F.col("_end._p") - F.coalesce(F.col("_got.p"), F.lit(-1))
    # a window without an increase between two values has no rate
    known = F.col("_end._n") > F.coalesce(F.col("_got.n"), F.lit(0))
    inside = F.when(known, F.col("_end._sum") - F.coalesce(F.col("_got.s"), F.lit(0.0)))
    return found.where(n >= 2).select(*df.columns, (inside / float(range_s)).alias("rate"))


def agg_by(df: DataFrame, fn: str, by=(), ts="ts", value="value", name="value") -> DataFrame:
    """B-3: ``sum/avg/min/max/count by (labels)`` at each timestamp."""
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn]
    return df.groupBy(ts, *by).agg(f(value).alias(name))


def vector_binary(a: DataFrame, b: DataFrame, on, op: str, value="value") -> DataFrame:
    """B-4: label-matched arithmetic ``a op b``; unmatched series drop."""
    l_ = a.select(*on, F.col(value).alias("_a"))
    r_ = b.select(*on, F.col(value).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    expr = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y),
            "util": (1 - F.try_divide(x, y)) * 100}[op]
    return l_.join(r_, list(on)).select(*on, expr.alias(value))


def node_cpu_utilization(idle: DataFrame, range_s: int, instance="instance") -> DataFrame:
    """B-5: ``100 - avg by (instance) (rate(idle)) * 100``."""
    r = rate(idle, range_s, series=(instance,))
    return r.groupBy("ts", instance).agg((100 - F.avg("rate") * 100).alias("cpu_utilization"))


def node_memory_utilization(gauges: DataFrame, instance="instance") -> DataFrame:
    """B-6: ``(1 - available / total) * 100`` per (instance, ts)."""
    a = gauges.where(F.col("metric") == "mem_available")
    t = gauges.where(F.col("metric") == "mem_total")
    return vector_binary(a, t, ["ts", instance], "util").withColumnRenamed("value", "memory_utilization")


def histogram_quantile(buckets: DataFrame, q: float, series=("service",), ts="ts") -> DataFrame:
    """B-7: quantile by linear interpolation inside cumulative ``le`` buckets.

    rank = q * count(+Inf); the first bucket with cumulative >= rank holds it;
    the first bucket's lower bound is 0; a rank in the +Inf bucket returns the
    highest finite bound; an empty histogram gives NULL.  One histogram (a few
    bucket rows) per window partition.
    """
    keys = [*series, ts]
    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.select(*keys, "le", "cumulative",
                       F.lag("le").over(w).alias("_lo"), F.lag("cumulative").over(w).alias("_cprev"),
                       F.max("cumulative").over(Window.partitionBy(*keys)).alias("_total"),
                       F.max(F.when(F.col("le") != float("inf"), F.col("le")))
                        .over(Window.partitionBy(*keys)).alias("_maxfin"))
    rank = F.col("_total") * q
    hit = b.where(F.col("cumulative") >= rank)
    pick = hit.groupBy(*keys).agg(F.min_by(F.struct("le", "_lo", "cumulative", "_cprev", "_total", "_maxfin"),
                                           "le").alias("h"))
    le, lo, c, cp, tot, mf = (F.col(f"h.{n}") for n in ("le", "_lo", "cumulative", "_cprev", "_total", "_maxfin"))
    lo0 = F.coalesce(lo, F.lit(0.0))
    cp0 = F.coalesce(cp, F.lit(0)).cast("double")
    interp = lo0 + (le - lo0) * F.try_divide(tot * q - cp0, c - cp0)
    val = (F.when(tot == 0, F.lit(None).cast("double"))
           .when(le == float("inf"), mf)
           .when(c == cp0, le)
           .otherwise(interp))
    return pick.select(*keys, val.alias("quantile"))


def grid_rates(counters: DataFrame, start: str, end: str, step_s: int, range_s: int, series) -> DataFrame:
    """Counter rates (B-2) over the trailing ``range_s`` on a step grid (B-11): at
    each step the rate of the series' latest sample, while that is not older than
    the range.  Columns: series, ts, value."""
    r = rate(counters, range_s, series).select(*series, "ts", "seq", F.col("rate").alias("value"))
    return range_eval(r, start, end, step_s, range_s, series)


def error_ratio(counters: DataFrame, start: str, end: str, step_s: int, range_s: int, by=("service",),
                status="status") -> DataFrame:
    """B-8: rate of the 5xx counters over the rate of all counters, both over the
    trailing range, per step."""
    g = grid_rates(counters, start, end, step_s, range_s, [*by, status])
    failed = agg_by(select_series(g, re={status: "5.."}), "sum", by)
    return vector_binary(failed, agg_by(g, "sum", by), ["ts", *by], "/").withColumnRenamed("value", "error_ratio")


def requests_per_second(counters: DataFrame, start: str, end: str, step_s: int, range_s: int, sources,
                        by=("service",), status="status") -> DataFrame:
    """B-9: rate of the non-5xx counters over the trailing range, per step, from
    the first of ``sources`` (metric names in order) that a service has."""
    ok = select_series(counters, nre={status: "5.."})
    g = grid_rates(ok.where(F.col("metric").isin(*sources)), start, end, step_s, range_s, ["metric", *by, status])
    found = [agg_by(g.where(F.col("metric") == m), "sum", by) for m in sources]
    return first_available(found, by).withColumnRenamed("value", "requests_per_second")


def first_available(candidates, series=("service",)) -> DataFrame:
    """B-13: ordered fallback - per series keep the rows of the first
    candidate (by list order) that has any.  One pass: union with a priority,
    a per-series min(priority) table (small, broadcast) joined back."""
    tagged = [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = u.groupBy(*series).agg(F.min("priority").alias("priority"))
    return u.join(maybe_broadcast(best), [*series, "priority"])


def cpu_throttled_rate(throttled_seconds: DataFrame, throttled_periods: DataFrame, range_s: int,
                       series=("service",)) -> DataFrame:
    """B-10: rate of throttled seconds where that counter exists, else of
    throttled periods (per series)."""
    a = rate(throttled_seconds, range_s, series)
    b = rate(throttled_periods, range_s, series)
    return first_available([a, b], series)


def range_eval(df: DataFrame, start: str, end: str, step_s: int, lookback_s: int = 300,
               series=("service",), ts="ts", value="value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """B-11: value of each series on the step grid ``start..end``: the latest
    sample in ``(t - lookback, t]``; no row when the series is stale.

    Only samples that some step can see are read (both bounds reach the scan).
    Of the samples between two steps the latest is kept, and stands for the steps
    up to the next one kept, as long as it is fresh."""
    series = list(series)
    kind = df.schema[ts].dataType
    first, last = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    lookback = F.expr(f"make_dt_interval(0, 0, 0, {lookback_s})")
    seen = df.where((F.col(ts) > (first - lookback).cast(kind)) & (F.col(ts) <= last.cast(kind)) & F.col(value).isNotNull())
    begin, stop = df.sparkSession.range(1).select(F.unix_micros(first), F.unix_micros(last)).first()
    step, steps = step_s * US, (stop - begin) // (step_s * US) + 1
    s = seen.withColumn("_t", epoch_us(ts)).withColumn("_i", F.expr(f"(greatest(_t - {begin}L, 0L) + {step - 1}L) div {step}L"))
    # equal times by the order of the samples, where they have one
    latest = F.struct("_t", *[c for c in ("seq",) if c in df.columns], F.col(value).cast("double").alias("_v"))
    kept = s.groupBy(*series, "_i").agg(F.max(latest).alias("_last"))

    def until(d, parts):
        return d.withColumn("_next", F.lead("_i").over(Window.partitionBy(*parts).orderBy("_i")))

    if steps <= chunk_rows:  # a series has no more rows than steps
        kept = until(kept, series)
    else:
        kept = by_chunks_both(dense_position(kept, series, ["_i"], "_p", chunk_rows), series, "_p", 1, until, chunk_rows)
    fresh = F.expr(f"(_last._t + {lookback_s * US - 1 - begin}L) div {step}L")
    upto = F.least(fresh, F.coalesce(F.col("_next") - 1, F.lit(steps - 1)), F.lit(steps - 1))
    out = kept.where(F.col("_i") <= upto).select(*series, F.explode(F.sequence("_i", upto)).alias("_i"), "_last")
    return out.select(*series, F.timestamp_micros(F.lit(begin) + F.col("_i") * step).cast(kind).alias(ts), F.col("_last._v").alias(value))


def time_range(df: DataFrame, end: str, duration_s: int = 3600, ts="ts") -> DataFrame:
    """B-12: rows in ``[end - duration, end]``; ``end`` is an argument (no now())."""
    e = F.to_timestamp(F.lit(end))
    lo = e - F.expr(f"make_dt_interval(0, 0, 0, {duration_s})")
    t = F.col(ts).cast("timestamp")
    return df.where((t >= lo) & (t <= e))


# Raw metric -> collected series.
COLLECTED = {"cpu_seconds": "cpu_cores", "net_rx": "net_rx_bytes", "net_tx": "net_tx_bytes",
             "mem_working_set": "mem_bytes", "restarts": "pod_restarts", "replicas": "replica_count"}
RATED = ("cpu_seconds", "net_rx", "net_tx")
PANEL_RATES = ("net_rx", "net_tx", "fs_read", "fs_write")
PANEL_VALUES = ("pod_phase", "replicas", "restarts")


def collected_series(raw: DataFrame, start: str, end: str, step_s: int, range_s: int, by=("service",),
                     instance="instance") -> DataFrame:
    """B-14: the eight collected series on a step grid, as (metric, key, ts,
    value).  Counters are rated over the trailing range, gauges and the restart
    count are taken as they are, both summed by service; node cpu and memory
    utilisation (B-5, B-6) are by instance."""
    keys = ["metric", *by, instance]
    rated = rate(raw.where(F.col("metric").isin(*RATED)), range_s, keys).select(*keys, "ts", "seq", F.col("rate").alias("value"))
    plain = raw.where(F.col("metric").isin(*[m for m in COLLECTED if m not in RATED])).select(*keys, "ts", "seq", "value")
    g = range_eval(rated.unionByName(plain), start, end, step_s, range_s, keys)
    names = F.create_map(*[F.lit(x) for pair in COLLECTED.items() for x in pair])
    per = agg_by(g.withColumn("metric", names[F.col("metric")]), "sum", ["metric", *by])
    per = per.select("metric", F.concat_ws("/", *by).alias("key"), "ts", "value")
    idle = grid_rates(raw.where(F.col("metric") == "node_idle"), start, end, step_s, range_s, [instance])
    cpu = idle.select(F.lit("node_cpu_util").alias("metric"), F.col(instance).alias("key"), "ts", (100 - F.col("value") * 100).alias("value"))
    gauges = raw.where(F.col("metric").isin("mem_available", "mem_total"))
    mem = node_memory_utilization(range_eval(gauges, start, end, step_s, range_s, ["metric", instance]), instance)
    mem = mem.select(F.lit("node_mem_util").alias("metric"), F.col(instance).alias("key"), "ts", F.col("memory_utilization").alias("value"))
    return per.unionByName(cpu).unionByName(mem)


def panel_queries(samples: DataFrame, step: str = "1 hour") -> DataFrame:
    """B-15: dashboard aggregates - avg cpu by pod, sum cpu by container,
    avg and sum memory by service - as ONE grouping-sets aggregate (one
    shuffle for all panels).  A sample without a label is filed under the panel
    with a NULL key."""
    t = F.window("ts", step).start.alias("ts")
    g = samples.select("metric", "service", "pod", "container", t, "value")
    gs = g.groupingSets([["metric", "ts", "pod"], ["metric", "ts", "container"], ["metric", "ts", "service"]],
                        "metric", "ts", "pod", "container", "service")
    agg = gs.agg(F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value"),
                 F.grouping("pod").alias("_no_pod"), F.grouping("container").alias("_no_container"))
    key = F.when(F.col("_no_pod") == 0, F.col("pod")).when(F.col("_no_container") == 0, F.col("container")).otherwise(F.col("service"))
    level = F.when(F.col("_no_pod") == 0, "pod").when(F.col("_no_container") == 0, "container").otherwise("service")
    return agg.select("metric", "ts", level.alias("by"), key.alias("key"), "avg_value", "sum_value")


def series_panels(raw: DataFrame, start: str, end: str, step_s: int, range_s: int,
                  series=("metric", "service", "instance")) -> DataFrame:
    """B-15, the panels by series: receive, transmit and file-system rates over
    the trailing range, and pod phase, replicas and restarts as they are, on a
    step grid."""
    series = list(series)
    rated = rate(raw.where(F.col("metric").isin(*PANEL_RATES)), range_s, series).select(*series, "ts", "seq", F.col("rate").alias("value"))
    plain = raw.where(F.col("metric").isin(*PANEL_VALUES)).select(*series, "ts", "seq", "value")
    return range_eval(rated.unionByName(plain), start, end, step_s, range_s, series)


def metric_names(samples: DataFrame) -> DataFrame:
    """B-16: the names of all metrics."""
    return samples.select("metric").distinct()


def available_metrics(samples: DataFrame, probe) -> DataFrame:
    """B-16: for each probed metric name, whether it has rows and how many."""
    spark = samples.sparkSession
    p = spark.createDataFrame([(m,) for m in probe], "metric string")
    counts = samples.groupBy("metric").agg(F.count("*").alias("n_rows"))
    j = p.join(counts, "metric", "left")
    return j.select("metric", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.col("n_rows").isNotNull().alias("available"))
