"""Readers (A-1..A-10): exported metric results, experiment tables and
records, inventories and request logs, all with explicit schemas."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (EXPERIMENT_RECORD, FEATURES, INVENTORY, PODS, RANGE_ITEMS, REQUEST_LOG_COLUMNS,
                       STRATEGY_RESULTS, VECTOR_ITEMS)

DONE = ("completed", "completed_with_warnings")


def value_columns(df: DataFrame) -> list[str]:
    """A-1: columns whose lower-case name contains ``value`` (or start with
    ``__value``); else the first numeric column; else none."""
    cols = [c for c in df.columns if "value" in c.lower() or c.startswith("__value")]
    if cols:
        return cols
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return num[:1]


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema`` by NAME with ``try_cast``; missing columns -> NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields],
                     *([F.col("source_file")] if "source_file" in have else []))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder or pattern, through the file system that Spark uses."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = p.getFileSystem(conf), []
    for st in fs.globStatus(p) or []:
        if st.isFile():
            out.append(st.getPath().toString())
            continue
        below = fs.listFiles(st.getPath(), True)
        while below.hasNext():
            out.append(below.next().getPath().toString())
    return [f for f in out if not f.rsplit("/", 1)[-1].startswith(("_", "."))]


def _first_line(spark: SparkSession, file: str) -> str:
    """First line of one file; nothing beyond its first block is read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(file)
    r = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p), "UTF-8"))
    try:
        return r.readLine() or ""
    finally:
        r.close()


def read_experiments(spark: SparkSession, path: str, service: str | None = None,
                     schema: T.StructType = FEATURES, base_path: str | None = None) -> DataFrame:
    """A-2: experiment CSVs; files whose headers differ (schema drift) are
    read per header and combined by column NAME with NULL fill.  Only the first
    line of each file is looked at for its header."""
    files = _files(spark, path)
    with ThreadPoolExecutor(16) as pool:
        firsts = list(pool.map(lambda f: _first_line(spark, f), files))
    by_header: dict[str, list[str]] = {}
    for f, line in zip(files, firsts):
        if line:
            by_header.setdefault(line, []).append(f)
    if not by_header:
        return spark.createDataFrame([], schema)
    parts = []
    for _, names in sorted(by_header.items()):
        r = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if base_path:
            r = r.option("basePath", base_path)      # keeps partition columns such as service
        parts.append(_typed(r.csv(names).withColumn("source_file", F.input_file_name()), schema))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.where(F.col("service") == service) if service else out


def read_experiment_records(spark: SparkSession, path: str, services=None, multiline: bool = True) -> DataFrame:
    """A-3: experiment record JSON, finished runs only, optionally per service."""
    r = spark.read.schema(EXPERIMENT_RECORD).option("multiLine", multiline).json(path)
    r = r.where(F.col("status").isin(*DONE))
    return r.where(F.col("target_service").isin(*services)) if services else r


def _docs(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """One JSON document per file (exported responses) or per line (JSON lines)."""
    return spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("doc"),
                                                               F.input_file_name().alias("source_file"))


def read_range_results(spark: SparkSession, path: str, metric: str | None = None,
                       whole_files: bool = True) -> DataFrame:
    """A-4: saved range-query JSON in any of the three layouts
    (``{"data": {"result": [...]}}``, ``{"result": [...]}``, ``[...]``) ->
    long samples (labels, ts, value).  Values that are not numbers -> NULL."""
    d = _docs(spark, path, whole_files)
    items = F.coalesce(
        F.from_json("doc", T.StructType([T.StructField("data", T.StructType(
            [T.StructField("result", RANGE_ITEMS)]))]))["data"]["result"],
        F.from_json("doc", T.StructType([T.StructField("result", RANGE_ITEMS)]))["result"],
        F.from_json("doc", RANGE_ITEMS))
    x = d.select(F.explode(items).alias("it"), "source_file")
    v = x.select(F.col("it.metric").alias("labels"), F.explode("it.values").alias("v"))
    out = v.select("labels", F.timestamp_micros(F.round(F.get("v", 0).try_cast("double") * 1e6).cast("long")).alias("ts"),
                   F.get("v", 1).try_cast("double").alias("value"))
    name = F.coalesce(F.col("labels")["__name__"], F.lit(metric))
    return out.select(name.alias("metric"), "labels", "ts",
                      F.when(F.isnan("value"), None).otherwise(F.col("value")).alias("value"))


def read_instant_vector(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """A-5: instant-vector responses -> (labels, ts, value); a missing or
    short ``value`` gives 0."""
    d = _docs(spark, path, whole_files)
    items = F.coalesce(
        F.from_json("doc", T.StructType([T.StructField("data", T.StructType(
            [T.StructField("result", VECTOR_ITEMS)]))]))["data"]["result"],
        F.from_json("doc", VECTOR_ITEMS))
    x = d.select(F.explode(items).alias("it"))
    val = F.get("it.value", 1).try_cast("double")
    ts = F.coalesce(F.col("it.timestamp").try_cast("double"), F.get("it.value", 0).try_cast("double"))
    return x.select(F.col("it.metric").alias("labels"),
                    F.timestamp_micros(F.round(ts * 1e6).cast("long")).alias("ts"),
                    F.coalesce(val, F.lit(0.0)).alias("value"))


def resource_requests(vec: DataFrame) -> DataFrame:
    """A-6: instant vector of resource requests -> (pod, container, resource, value)."""
    lab = F.col("labels")
    res = F.coalesce(lab["resource"],
                     F.when(lab["__name__"].contains("memory"), "memory").when(lab["__name__"].contains("cpu"), "cpu"))
    return vec.select(lab["pod"].alias("pod"), lab["container"].alias("container"), res.alias("resource"), "value")


def flatten_inventory(df: DataFrame) -> DataFrame:
    """A-7: deployments or pods -> one row per container with requests,
    limits and (pods) readiness / restarts matched by container name."""
    has_status = "statuses" in df.columns
    x = df.select("*", F.explode_outer("containers").alias("c"))
    cols = [F.col("name").alias("owner"), "namespace", F.col("c.name").alias("container"),
            F.col("c.image").alias("image"),
            F.col("c.requests")["cpu"].alias("cpu_request"), F.col("c.requests")["memory"].alias("memory_request"),
            F.col("c.limits")["cpu"].alias("cpu_limit"), F.col("c.limits")["memory"].alias("memory_limit")]
    if has_status:
        st = F.get(F.filter("statuses", lambda s: s["name"] == F.col("c.name")), 0)
        cols += [st["ready"].alias("ready"), st["restart_count"].alias("restart_count")]
    return x.select(*cols)


def flatten_usage(df: DataFrame, service: str) -> DataFrame:
    """A-8: pod usage list -> (pod, container, cpu_usage, memory_usage) for
    pods whose name contains the service."""
    x = df.where(F.col("pod").contains(service)).select("pod", F.explode("containers").alias("c"))
    return x.select("pod", F.col("c.name").alias("container"),
                    F.col("c.usage.cpu").alias("cpu_usage"), F.col("c.usage.memory").alias("memory_usage"))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """A-9: load-test request log CSV (header) -> typed (timeStamp ms, elapsed
    ms, label, success boolean; D-2: success is a boolean, not text)."""
    d = spark.read.option("header", True).csv(path)
    return d.select(*[F.col(c).try_cast(t).alias(c) for c, t in REQUEST_LOG_COLUMNS])


def read_strategy_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A-10: comparative-results JSON -> one row per experiment, flat."""
    r = spark.read.schema(STRATEGY_RESULTS).option("multiLine", multiline).json(path)
    x = r.select(F.col("service_name").alias("file_service"), F.explode("experiments").alias("e"))
    s = "e.summary"
    return x.select(
        F.col("e.experiment_id").alias("experiment_id"), F.col("e.service_name").alias("service_name"),
        F.col("e.strategy").alias("strategy"), F.col("e.status").alias("status"),
        F.col(f"{s}.data_points").alias("data_points"),
        F.col(f"{s}.cost_efficiency.total_cpu_hours").alias("total_cpu_hours"),
        F.col(f"{s}.cost_efficiency.total_memory_hours").alias("total_memory_hours"),
        F.col(f"{s}.cost_efficiency.avg_cpu_cores").alias("avg_cpu_cores"),
        F.col(f"{s}.cost_efficiency.avg_memory_gb").alias("avg_memory_gb"),
        F.col(f"{s}.performance_integrity.avg_p95_latency").alias("avg_p95_latency"),
        F.col(f"{s}.performance_integrity.max_p95_latency").alias("max_p95_latency"),
        F.col(f"{s}.performance_integrity.avg_error_rate").alias("avg_error_rate"),
        F.col(f"{s}.performance_integrity.avg_throughput").alias("avg_throughput"),
        F.col(f"{s}.stability.scaling_events").alias("scaling_events"),
        F.col(f"{s}.stability.avg_volatility").alias("avg_volatility"),
        F.col(f"{s}.stability.max_volatility").alias("max_volatility"))


__all__ = ["value_columns", "read_experiments", "read_experiment_records", "read_range_results",
           "read_instant_vector", "resource_requests", "flatten_inventory", "flatten_usage",
           "read_request_log", "read_strategy_results", "INVENTORY", "PODS"]
