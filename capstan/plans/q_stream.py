"""Registered streaming queries (T-2..T-5): each runs its stream over the
events table to completion (``availableNow``) into a parquet table in the
shared checkpoint folder and returns that table as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import late
from ..streaming import streams as st
from .q_strategy import _STAB_SQL
from .registry import register


def _events(spark, sf):
    return st.table_stream(spark, f"{sf}/events.parquet")


def _table(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@register("stream_profile", adapters=["samples"], floats=["mean", '"max"', "total"], sql="""
    SELECT service, metric, time_bucket(INTERVAL 30 SECOND, ts) AS window_start,
           time_bucket(INTERVAL 30 SECOND, ts) + INTERVAL 30 SECOND AS window_end,
           count(*) AS n, avg(value) AS mean, max(value) AS "max", sum(value) AS total
    FROM samples GROUP BY 1, 2, 3, 4""")
def stream_profile(spark, sf):
    """T-1 (file stream of samples) + T-2: 30 s tumbling-window profile per (service, metric)."""
    out = st.run_windows(st.stream_profile, st.sample_stream(_events(spark, sf)), st.sample_stream(_table(spark, sf)),
                         "profile", "30 SECONDS")
    return out.select("service", "metric", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", "mean", "max", "total")


@register("stream_rightsize", adapters=["samples"], floats=["mem_max"], sql="""
    WITH w AS (SELECT *, unnest([0, 1, 2]) AS back FROM samples),
    s AS (SELECT service, metric, value, time_bucket(INTERVAL 2 MINUTE, ts) - back * INTERVAL 2 MINUTE AS window_start, ts FROM w)
    SELECT service, window_start, window_start + INTERVAL 5 MINUTE AS window_end,
           max(CASE WHEN metric = 'mem_bytes' THEN value END) AS mem_max,
           count(CASE WHEN metric = 'cpu_cores' THEN value END) AS n_cpu
    FROM s WHERE ts < window_start + INTERVAL 5 MINUTE GROUP BY service, window_start""")
def stream_rightsize(spark, sf):
    """T-3: recommendation over trailing 5 minutes every 2 minutes.  The memory
    maximum, counts and windows are compared with SQL; the approximate p95 and
    the texts made from it by the tests."""
    out = st.run_windows(st.stream_rightsize, st.sample_stream(_events(spark, sf)), st.sample_stream(_table(spark, sf)),
                         "rightsize", "5 MINUTES", "2 MINUTES")
    return out.select("service", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "mem_max", "n_cpu")


PERIOD_DAYS = 6


def _arrivals(spark, sf, windows):
    """A profile run over events as they arrive: files of six days at a time, in which
    every tenth event is one period late.  A run takes what has arrived as one
    micro-batch and ends; the next goes on from its tables.  Returns the folder of the
    tables, the stream and the events."""
    events = _table(spark, sf)
    day = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    period = F.floor(day / PERIOD_DAYS) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    landing, base = scratch_path(spark, "arrivals"), scratch_path(spark, "arrivals-run")
    stream = st.sample_stream(spark.readStream.schema(events.schema).parquet(landing + "/*"))
    for p in [r[0] for r in events.select(period.alias("p")).where("p IS NOT NULL").distinct().orderBy("p").collect()]:  # one a period
        events.where(period == p).write.parquet(f"{landing}/period={p}")
        late.run_windows_with_late(st.stream_profile, stream, windows, base=base)
    return base, stream, st.sample_stream(events)


_ARRIVALS_SQL = f"""
    arrived AS (
      SELECT *, CAST(floor((CAST(ts AS DATE) - DATE '1970-01-01') / {PERIOD_DAYS}) AS BIGINT) + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END AS period
      FROM samples),
    marks AS (
      SELECT period, row_number() OVER (ORDER BY period) - 1 AS batch,
             max(max(ts)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS missed
      FROM arrived GROUP BY period)"""


@register("stream_late_rows", adapters=["samples"], floats=["total"], sql=f"""
    WITH {_ARRIVALS_SQL}
    SELECT batch, missed, service, metric, count(*) AS n_late, sum(value) AS total
    FROM arrived JOIN marks USING (period)
    WHERE time_bucket(INTERVAL 30 SECOND, ts) + INTERVAL 30 SECOND <= missed GROUP BY 1, 2, 3, 4""")
def stream_late_rows(spark, sf):
    """Side table of a stream of files out of time order: the rows that come behind
    the watermark, by micro-batch."""
    root, stream, _ = _arrivals(spark, sf, late.Windows.of(spark, "30 SECONDS", "10 MINUTES"))
    return late.late_rows(root, stream).groupBy(
        "batch", F.col("missed").cast("timestamp_ntz").alias("missed"), "service", "metric").agg(
        F.count("*").alias("n_late"), F.sum("value").alias("total"))


@register("stream_profile_of_arrivals", adapters=["samples"], floats=["mean", '"max"', "total"], sql="""
    SELECT service, metric, time_bucket(INTERVAL 30 SECOND, ts) AS window_start,
           time_bucket(INTERVAL 30 SECOND, ts) + INTERVAL 30 SECOND AS window_end,
           count(*) AS n, avg(value) AS mean, max(value) AS "max", sum(value) AS total
    FROM samples GROUP BY 1, 2, 3, 4""")
def stream_profile_of_arrivals(spark, sf):
    """T-2 over files out of time order: closed windows and late rows make the whole
    profile."""
    windows = late.Windows.of(spark, "30 SECONDS", "10 MINUTES")
    root, stream, table = _arrivals(spark, sf, windows)
    out = late.complete(root, st.stream_profile, stream, table, windows)
    return out.select("service", "metric", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", "mean", "max", "total")


@register("stream_stability", adapters=["strategy_samples"], floats=["cpu_utilization", "volatility"], sql=f"""
    SELECT experiment_id, seq, replica_count, cpu_utilization, volatility, scaling_event FROM ({_STAB_SQL}) s""")
def stream_stability(spark, sf):
    """T-4: volatility / scaling events with table-kept state; equals L-4 + L-5."""
    out = st.run_stability(st.strategy_stream(_events(spark, sf)), st.strategy_stream(_table(spark, sf)))
    return out.select("experiment_id", "seq", "replica_count", "cpu_utilization",
                                           "volatility", "scaling_event")


@register("stream_summary", adapters=["strategy_samples"],
          floats=["duration_hours", "total_cpu_hours", "total_memory_hours", "avg_p95_latency", "max_p95_latency",
                  "avg_error_rate", "avg_throughput", "avg_sla_compliance"], sql="""
    SELECT experiment_id, service_name, strategy, status, count(*) AS data_points,
           sum(elapsed_hours) AS duration_hours, sum(cpu_cores * elapsed_hours) AS total_cpu_hours,
           sum(memory_gb * elapsed_hours) AS total_memory_hours,
           coalesce(avg(p95_latency) FILTER (WHERE p95_latency > 0), 0.0) AS avg_p95_latency,
           coalesce(max(p95_latency) FILTER (WHERE p95_latency > 0), 0.0) AS max_p95_latency,
           avg(error_rate) AS avg_error_rate, avg(throughput) AS avg_throughput,
           avg(CASE WHEN error_rate < 0.05 THEN 1.0 - error_rate ELSE 0.0 END) AS avg_sla_compliance
    FROM strategy_samples
    GROUP BY experiment_id, service_name, strategy, status""")
def stream_summary(spark, sf):
    """T-5: running experiment summaries (daily partials), folded into the L-6
    fields at the end of the run."""
    parts = st.run_windows(st.stream_summary, st.strategy_stream(_events(spark, sf)), st.strategy_stream(_table(spark, sf)),
                           "summary", "1 DAY", delay="1 hour")
    return st.finalize_summary(parts)
