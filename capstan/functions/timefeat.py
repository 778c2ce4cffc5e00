"""Identifier, time and small numeric feature expressions (Q-5..Q-14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_col

# Target buffers (cpu, memory, replicas) and regime bins.
BUFFERS = {"cpu": 1.2, "memory": 1.15, "replica": 1.0}
REGIME_EDGES = [0.0, 0.002, 0.01, float("inf")]
REGIME_EDGES_ALT = [0.001, 0.002, 0.01, float("inf")]
REGIME_LABELS = ["low", "medium", "high"]


def experiment_id(service, scenario, replicas, users) -> Column:
    """Q-5: ``<service>_<scenario>_replicas_<r>_users_<u>``."""
    return F.format_string("%s_%s_replicas_%d_users_%d", as_col(service), as_col(scenario),
                           as_col(replicas).cast("int"), as_col(users).cast("int"))


def parse_experiment_id(c) -> Column:
    """Q-6: struct(service, scenario, replica_count, load_users) from an id.
    Scenario from ``_browsing_`` / ``_checkout_`` (default browsing)."""
    c = as_col(c)
    scen = F.when(c.contains("_checkout_"), "checkout").otherwise("browsing")
    service = F.regexp_extract(c, r"^(.*?)_(browsing|checkout)_", 1)
    return F.struct(
        F.when(service == "", F.split(c, "_").getItem(0)).otherwise(service).alias("service"),
        scen.alias("scenario"),
        F.regexp_extract(c, r"_replicas_(\d+)", 1).try_cast("int").alias("replica_count"),
        F.regexp_extract(c, r"_users_(\d+)", 1).try_cast("int").alias("load_users"))


def sample_index(c) -> Column:
    """Q-7: ``t_<n>`` -> n (NULL when the text does not have that form)."""
    return F.regexp_extract(as_col(c), r"^t_(\d+)$", 1).try_cast("long")


def with_sample_index(df: DataFrame, col: str = "timestamp", keys=(), mode: str = "strict",
                      out: str = "time_index") -> DataFrame:
    """Q-7 with its gate, evaluated per group in one aggregate:
    ``strict`` - every row must have the ``t_`` form, else the index is NULL;
    ``lenient`` - more than 80 % must, failures map to 0."""
    share = F.avg(F.col(col).startswith("t_").cast("double"))
    idx = sample_index(col)
    from ..session import maybe_broadcast
    if keys:
        d = df.join(maybe_broadcast(df.groupBy(*keys).agg(share.alias("_share"))), list(keys))
    else:
        d = df.crossJoin(F.broadcast(df.agg(share.alias("_share"))))  # one row
    if mode == "strict":
        v = F.when(F.col("_share") == 1.0, idx)
    else:
        v = F.when(F.col("_share") > 0.8, F.coalesce(idx, F.lit(0)))
    return d.withColumn(out, v).drop("_share")


def calendar_from_ts(ts) -> list[Column]:
    """Q-8 from a timestamp: hour, day of week (Monday = 0), weekend flag."""
    t = as_col(ts)
    dow = F.weekday(t)
    return [F.hour(t).alias("hour"), dow.alias("day_of_week"), dow.isin(5, 6).cast("int").alias("is_weekend")]


def calendar_from_index(idx) -> list[Column]:
    """Q-8 from a sample index: hour = idx % 24, day = (idx div 24) % 7."""
    i = as_col(idx)
    dow = F.pmod(F.floor(i / 24), F.lit(7))
    return [F.pmod(i, F.lit(24)).alias("hour"), dow.alias("day_of_week"),
            dow.isin(5, 6).cast("int").alias("is_weekend")]


def minutes_since_start(df: DataFrame, ts: str, keys, out: str = "minutes_since_start") -> DataFrame:
    """Q-9: minutes since the group's first timestamp (group min joined back)."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("_t0"))
    j = df.join(first, list(keys))
    secs = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6
    return j.withColumn(out, secs / 60.0).drop("_t0")


def cyclical(hour, dow) -> list[Column]:
    """Q-10: sin/cos encodings of hour (24) and day of week (7)."""
    h, d = as_col(hour), as_col(dow)
    return [F.sin(2 * math.pi * h / 24).alias("hour_sin"), F.cos(2 * math.pi * h / 24).alias("hour_cos"),
            F.sin(2 * math.pi * d / 7).alias("day_sin"), F.cos(2 * math.pi * d / 7).alias("day_cos")]


def per_replica(c, replicas) -> Column:
    """Q-11: value / max(replicas, 1)."""
    return as_col(c) / F.greatest(as_col(replicas), F.lit(1))


def log_abs(c) -> Column:
    """Q-12: log1p(|x|)."""
    return F.log1p(F.abs(as_col(c)))


def bin_column(c, edges, labels, missing: str = "nan") -> Column:
    """Q-13: right-closed bins ``(e0, e1]``, ``(e1, e2]``...; outside -> ``missing``."""
    x = as_col(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi) if hi != float("inf") else (x > lo)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.otherwise(missing)


def apply_buffer(c, factor: float) -> Column:
    """Q-14: target with headroom (cpu x1.2, memory x1.15, replicas x1.0)."""
    return as_col(c) * factor
