"""Structured Streaming variants of the operators (T-1..T-5).

The reference polls one sample every 30 s in a loop; here samples arrive as
files and the same aggregates run incrementally:

* T-1 ``sample_stream``      - a file stream of the samples table;
* T-2 ``stream_profile``     - per-service tumbling-window aggregates (watermark, append);
* T-3 ``stream_rightsize``   - sliding 5-minute windows every 2 minutes with
  the statistical recommendation (approximate p95, bounded state);
* T-4 ``stream_stability``   - L-4 / L-5 (volatility over the previous 10
  samples, scaling events) with state kept as a *table*: each micro-batch
  runs the batch window operator over (carry + new rows) in ``foreachBatch``
  and stores the last 10 rows per experiment as the next carry;
* T-5 ``stream_summary``     - per (experiment, window) partial summaries
  (watermark, append) that :func:`finalize_summary` folds into L-6.

Spark's append mode holds back the windows that the watermark has not passed and
drops later rows.  Finite runs of T-2, T-3 and T-5 go through
:mod:`capstan.streaming.late` instead: windows close as the watermark passes, late
rows go to a table of their own with their micro-batch, and only the windows that
they belong to are computed again.  Sinks write into
the shared checkpoint folder, never to the driver; a run is waited for without a time limit, and its
failure is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantities import format_cpu, format_memory
from ..operators.rightsize import recommend_cpu_expr, recommend_memory_expr
from ..operators.strategy import SLA_ERROR_LIMIT, VOLATILITY_WINDOW, stability_features
from ..session import maybe_broadcast, scratch_path
from .late import Windows, complete, run_windows_with_late

APPROX_ACCURACY = 10000


#: Input files of a micro-batch.
FILES_PER_BATCH = 64


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def table_stream(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """A file stream over a parquet table: a directory, or a single file by a
    pattern that fits its name alone (the file source lists, it cannot open one).
    A micro-batch takes at most ``max_files`` files."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    src = path if _is_dir(spark, path) else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)


def sample_stream(events: DataFrame) -> DataFrame:
    """T-1: long samples from an events stream (the ``samples`` adapter
    mapping, stream-safe: projection and generator only), event time as
    TIMESTAMP (watermarks need the local-time-zone type)."""
    from ..sources.adapters import samples_of
    return samples_of(events).withColumn("ts", F.col("ts").cast("timestamp"))


def strategy_stream(events: DataFrame) -> DataFrame:
    """T-1 for strategy experiments: the strategy-samples mapping on a stream."""
    from ..sources.adapters import strategy_samples_of
    return strategy_samples_of(events).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_profile(samples: DataFrame, interval: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """T-2: per (service, metric, tumbling window) count / mean / max / sum."""
    return (samples.withWatermark("ts", watermark)
            .groupBy("service", "metric", F.window("ts", interval).alias("w"))
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"),
                 F.sum("value").alias("total"))
            .select("service", "metric", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n", "mean", "max", "total"))


def stream_rightsize(samples: DataFrame, over: str = "5 minutes", every: str = "2 minutes",
                     watermark: str = "10 minutes") -> DataFrame:
    """T-3: the statistical recommendation over the trailing ``over`` window,
    re-evaluated every ``every`` (sliding windows; approximate p95 keeps the
    state per window bounded)."""
    v = F.col("value")
    agg = (samples.withWatermark("ts", watermark)
           .groupBy("service", F.window("ts", over, every).alias("w"))
           .agg(F.percentile_approx(F.when(F.col("metric") == "cpu_cores", v), 0.95, APPROX_ACCURACY).alias("p95"),
                F.max(F.when(F.col("metric") == "mem_bytes", v)).alias("mem_max"),
                F.count(F.when(F.col("metric") == "cpu_cores", v)).alias("n_cpu")))
    cores = recommend_cpu_expr(F.col("p95"))
    mem = recommend_memory_expr(F.col("mem_max"))
    return agg.select("service", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "p95", "mem_max", "n_cpu", format_cpu(cores).alias("recommended_cpu"),
                      format_memory(mem).alias("recommended_memory"))


def stream_summary(strategy_samples: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """T-5: additive partial summaries per (experiment, window); emitted once
    the watermark passes the window end (append mode)."""
    p95 = F.col("p95_latency")
    sla = F.when(F.col("error_rate") < SLA_ERROR_LIMIT, 1.0 - F.col("error_rate")).otherwise(0.0)
    return (strategy_samples.withWatermark("ts", watermark)
            .groupBy("experiment_id", "service_name", "strategy", "status", F.window("ts", window).alias("w"))
            .agg(F.count("*").alias("n"), F.sum("elapsed_hours").alias("hours"),
                 F.sum(F.col("cpu_cores") * F.col("elapsed_hours")).alias("cpu_hours"),
                 F.sum(F.col("memory_gb") * F.col("elapsed_hours")).alias("memory_hours"),
                 F.sum(F.when(p95 > 0, p95)).alias("p95_sum"), F.count(F.when(p95 > 0, p95)).alias("p95_n"),
                 F.max(F.when(p95 > 0, p95)).alias("p95_max"),
                 F.sum("error_rate").alias("err_sum"), F.sum("throughput").alias("tput_sum"),
                 F.sum(sla).alias("sla_sum"))
            .withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w"))


def finalize_summary(parts: DataFrame) -> DataFrame:
    """T-5 final: fold the partial summaries into the L-6 cost / performance fields."""
    g = parts.groupBy("experiment_id", "service_name", "strategy", "status").agg(
        F.sum("n").alias("data_points"), F.sum("hours").alias("duration_hours"),
        F.sum("cpu_hours").alias("total_cpu_hours"), F.sum("memory_hours").alias("total_memory_hours"),
        F.sum("p95_sum").alias("_ps"), F.sum("p95_n").alias("_pn"), F.max("p95_max").alias("_pm"),
        F.sum("err_sum").alias("_es"), F.sum("tput_sum").alias("_ts"), F.sum("sla_sum").alias("_ss"))
    n = F.col("data_points")
    return g.select(
        "experiment_id", "service_name", "strategy", "status", "data_points", "duration_hours",
        "total_cpu_hours", "total_memory_hours",
        F.coalesce(F.try_divide(F.col("_ps"), F.col("_pn")), F.lit(0.0)).alias("avg_p95_latency"),
        F.coalesce(F.col("_pm"), F.lit(0.0)).alias("max_p95_latency"),
        (F.col("_es") / n).alias("avg_error_rate"), (F.col("_ts") / n).alias("avg_throughput"),
        (F.col("_ss") / n).alias("avg_sla_compliance"))


def _finish(query) -> None:
    """Wait for the end of a run and raise what ended it, if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> str:
    """Run a stream to completion (``availableNow``) into a parquet table;
    ``base`` is a fixed shared location (restartable), by default a fresh
    folder under the shared checkpoint folder.  Returns the table path.  In append
    mode rows behind the watermark are dropped and the last windows held back;
    :func:`run_windows` loses none."""
    root = base.rstrip("/") if base else scratch_path(stream.sparkSession, f"stream-{name}")
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", root + "/_checkpoint").option("path", root + "/data")
         .trigger(availableNow=True).start())
    _finish(q)
    return root + "/data"


def run_windows(aggregate, stream: DataFrame, table: DataFrame, name: str, span: str, every: str | None = None,
                delay: str = "10 minutes", window_end: str = "window_end") -> DataFrame:
    """A windowed aggregate over a finite stream, complete (see
    :mod:`capstan.streaming.late`): the windows come from the stream, and those that
    late rows belong to from ``table`` (the same rows as a batch table).  Windows of
    length ``span`` begin every ``every`` (by default ``span``)."""
    windows = Windows.of(stream.sparkSession, span, delay, every, window_end)
    root = run_windows_with_late(aggregate, stream, windows, name)
    return complete(root, aggregate, stream, table, windows)


def stream_stability(strategy_samples: DataFrame, base: str | None = None, n: int = VOLATILITY_WINDOW) -> str:
    """T-4: volatility and scaling events with bounded state kept as a table.

    In each micro-batch the carry (last ``n`` rows per experiment from earlier
    batches) is unioned with the new rows and the batch window operator runs
    per experiment; output rows are the new ones, and the last ``n`` rows per
    experiment become the next carry.  Writes are keyed by batch id, so a
    retried batch overwrites its own output.  Rows older than the carry's
    newest row of their experiment (late data) are not used; each batch writes
    their number to ``late/batch=<id>``.
    Returns the output table path.
    """
    spark = strategy_samples.sparkSession
    root = base.rstrip("/") if base else scratch_path(spark, "stream-stability")
    cols = ["experiment_id", "ts", "seq", "replica_count", "cpu_utilization"]

    def latest_carry(before: int):
        # found in the shared folder, also after a restart
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(root + "/carry")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        ids = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
               if st.getPath().getName().startswith("batch=")]
        ids = [i for i in ids if i < before and fs.exists(jvm.org.apache.hadoop.fs.Path(
            f"{root}/carry/batch={i}/_SUCCESS"))]
        return f"{root}/carry/batch={max(ids)}" if ids else None

    def step(batch: DataFrame, batch_id: int):
        rows = batch.select(*cols).withColumn("_new", F.lit(True))
        late = spark.createDataFrame([(0,)], "late long")
        carry_path = latest_carry(batch_id)
        if carry_path:
            carry = spark.read.parquet(carry_path).withColumn("_new", F.lit(False))
            last = maybe_broadcast(carry.groupBy("experiment_id").agg(F.max(F.struct("ts", "seq")).alias("_last")))
            seen = rows.join(last, "experiment_id", "left").withColumn(
                "_late", F.coalesce(F.struct("ts", "seq") <= F.col("_last"), F.lit(False)))
            late = seen.agg(F.count_if("_late").alias("late"))
            rows = carry.unionByName(seen.where(~F.col("_late")).drop("_last", "_late"))
        late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        # the batch operator (chunked per experiment position, n-row halo)
        feats = stability_features(rows, n).where("_new")
        feats.select(*cols, "volatility", "scaling_event").write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")
        # a rank limit keeps n rows of an experiment in each task before the exchange
        newest = Window.partitionBy("experiment_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
        rows.withColumn("_rk", F.row_number().over(newest)).where(F.col("_rk") <= n).select(*cols) \
            .write.mode("overwrite").parquet(f"{root}/carry/batch={batch_id}")

    q = (strategy_samples.writeStream.foreachBatch(step)
         .option("checkpointLocation", root + "/_checkpoint").trigger(availableNow=True).start())
    _finish(q)
    return root + "/data"


def run_stability(stream: DataFrame, table: DataFrame) -> DataFrame:
    """T-4 over a finite stream, complete: from the stream, or in batch from
    ``table`` (the same rows as a batch table) if files out of time order made
    rows late."""
    spark = stream.sparkSession
    path = stream_stability(stream)
    late = spark.read.schema("late long").parquet(path[:-len("data")] + "late/*")
    if late.where(F.col("late") > 0).isEmpty():
        return spark.read.parquet(path)
    cols = ["experiment_id", "ts", "seq", "replica_count", "cpu_utilization"]
    return stability_features(table.select(*cols)).select(*cols, "volatility", "scaling_event")
