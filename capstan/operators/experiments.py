"""Experiment tables: alignment, master table, run plans and inventory views (X-1..X-14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefeat import experiment_id
from ..session import maybe_broadcast
from .windows import dense_position

# Statuses that count as a finished experiment.
DONE_STATUSES = ("completed", "completed_with_warnings")
RPS_PER_USER = 2.0


def unify_metrics(samples: DataFrame, keys, metrics, order=("ts", "seq"), value="value") -> DataFrame:
    """X-1: long -> wide aligned by POSITION: the k-th sample of every metric
    shares row ``t_k``; a shorter metric leaves NULLs.  The pivot uses the
    explicit metric list (no distinct pass)."""
    keys = list(keys)
    pos = dense_position(samples, [*keys, "metric"], order, "idx")
    wide = pos.groupBy(*keys, "idx").pivot("metric", list(metrics)).agg(F.first(value))
    return wide.select(*keys, "idx", F.concat(F.lit("t_"), F.col("idx").cast("string")).alias("timestamp"),
                       *[F.col(m).alias(f"{m}_value") for m in metrics])


def unify_metrics_multi(samples: DataFrame, keys, metrics, columns, order=("ts", "seq")) -> DataFrame:
    """X-2: like X-1 but every listed column is kept as ``<metric>_<column>``."""
    keys = list(keys)
    pos = dense_position(samples, [*keys, "metric"], order, "idx")
    aggs = [F.first(c).alias(c) for c in columns]
    wide = pos.groupBy(*keys, "idx").pivot("metric", list(metrics)).agg(*aggs)
    return wide.select(*keys, "idx", F.concat(F.lit("t_"), F.col("idx").cast("string")).alias("timestamp"),
                       *[F.col(f"{m}_{c}") for m in metrics for c in columns])


def build_master(records: DataFrame, tables: DataFrame, key: str = "experiment_id") -> DataFrame:
    """X-3: join finished experiment records to their tables, add the keys,
    ``requests_per_second`` fallback (users x 2.0) and replicas NULL -> 0."""
    rec = records.where(F.col("status").isin(*DONE_STATUSES)).select(
        key, F.col("target_service"), F.col("replica_count").alias("_rc"), F.col("load_users").alias("_lu"))
    j = tables.join(maybe_broadcast(rec), key)
    rps = (F.col("requests_per_second") if "requests_per_second" in tables.columns else F.lit(None))
    return j.withColumn("requests_per_second", F.coalesce(rps.cast("double"), F.col("_lu") * RPS_PER_USER)) \
            .withColumn("replica_count", F.coalesce(F.col("_rc"), F.lit(0))) \
            .withColumn("load_users", F.col("_lu")).drop("_rc", "_lu")


def experiment_grid(services: DataFrame, scenarios, replicas, users, service: str = "service") -> DataFrame:
    """X-4: the Cartesian run plan, generated per service with array
    generators (no join)."""
    g = services.select(F.col(service).alias("service")).distinct()
    g = g.select("service", F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"))
    g = g.select("*", F.explode(F.array(*[F.lit(int(r)) for r in replicas])).alias("replica_count"))
    g = g.select("*", F.explode(F.array(*[F.lit(int(u)) for u in users])).alias("load_users"))
    return g.withColumn("experiment_id", experiment_id("service", "scenario", "replica_count", "load_users"))


def remaining(grid: DataFrame, done: DataFrame, key: str = "experiment_id") -> DataFrame:
    """X-5: runs of the plan not yet completed (anti join)."""
    return grid.join(done.select(key), key, "left_anti")


def progress(grid: DataFrame, done: DataFrame, key: str = "experiment_id") -> DataFrame:
    """X-6: total / completed / remaining / percent (one row)."""
    d = done.select(key).distinct().withColumn("_done", F.lit(1))
    j = grid.select(key).distinct().join(d, key, "left")
    return j.agg(F.count("*").alias("total"), F.count("_done").alias("completed")).select(
        "total", "completed", (F.col("total") - F.col("completed")).alias("remaining"),
        F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(0.0).alias("percent"))


def next_runs(grid: DataFrame, done: DataFrame, n: int = 10, key: str = "experiment_id") -> DataFrame:
    """X-6: the first ``n`` remaining ids in sorted order (a top-n report)."""
    return remaining(grid, done, key).select(key).orderBy(key).limit(n)


def run_summary(results: DataFrame, status: str = "status") -> DataFrame:
    """X-7: totals by outcome and success rate (one row).  The id lists are
    the ``results`` rows themselves, filtered by status - not collected."""
    s = F.col(status)
    ok = s.isin(*DONE_STATUSES)
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped")).withColumn(
        "success_rate", F.when(F.col("total") > 0, F.col("successful") / F.col("total") * 100).otherwise(0.0))


def select_services(df: DataFrame, patterns, name: str = "service") -> DataFrame:
    """X-8: distinct names containing any pattern, case-insensitive."""
    low = F.lower(F.col(name))
    cond = reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in patterns])
    return df.select(name).where(cond).distinct()


def services_by_label(df: DataFrame, key: str, value: str | None = None, name: str = "pod") -> DataFrame:
    """X-9: items carrying a label, optionally with a given value."""
    cond = F.map_contains_key("labels", key)
    if value is not None:
        cond = cond & (F.col("labels").getItem(key) == value)
    return df.where(cond).select(name, "labels").dropDuplicates([name])


def service_labels(df: DataFrame, name: str = "pod") -> DataFrame:
    """X-9: the name -> labels listing, one row a name."""
    return df.select(name, "labels").dropDuplicates([name])


def _n_containers(d: DataFrame):
    if "n_containers" in d.columns:
        return F.col("n_containers")
    return F.size("containers").alias("n_containers")


def service_status(deployments: DataFrame) -> DataFrame:
    """X-10: ``ready`` when ready_replicas = replicas, else ``not_ready``; with the
    names of the containers where the inventory lists them."""
    names = [F.transform("containers", lambda c: c["name"]).alias("containers")] if "containers" in deployments.columns else []
    return deployments.select(
        "name", "replicas", "ready_replicas",
        F.when(F.col("ready_replicas") == F.col("replicas"), "ready").otherwise("not_ready").alias("status"),
        _n_containers(deployments), *names)


def system_summary(deployments: DataFrame, n: int = 5) -> DataFrame:
    """X-11: the first ``n`` services (by name) with replicas / ready / containers
    and the total service count on every row."""
    total = deployments.agg(F.count("*").alias("total_services"))
    first = deployments.select("name", "replicas", "ready_replicas", _n_containers(deployments)).orderBy("name").limit(n)
    return first.crossJoin(F.broadcast(total))  # one row


def latest_window(df: DataFrame, keys, n: int, order=("ts", "seq")) -> DataFrame:
    """X-12: the last ``n`` rows of each series (``tail(n)``).  The filter on
    ``row_number`` lets Spark apply a per-partition group limit before the
    shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def numeric_only(df: DataFrame, drop=()) -> DataFrame:
    """X-13: keep numeric columns only, minus ``drop``."""
    from pyspark.sql import types as T
    keep = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(drop)]
    return df.select(*keep)


def existing_services(wanted: DataFrame, inventory: DataFrame, name: str = "service") -> DataFrame:
    """X-14: requested services present in the inventory; missing ones become
    error rows."""
    inv = inventory.select(F.col(name).alias("_n")).distinct().withColumn("_found", F.lit(True))
    j = wanted.join(inv, wanted[name] == inv["_n"], "left")
    return j.select(name, F.when(F.col("_found"), "ok").otherwise("error").alias("status"),
                    F.when(F.col("_found").isNull(), F.concat(F.lit("Service "), F.col(name), F.lit(" not found")))
                    .alias("error"))
