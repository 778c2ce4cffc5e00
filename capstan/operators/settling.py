"""Stability of a controlled signal: reversals, settling time, resource efficiency.

* An oscillation is a change of direction: a rise after a fall or the reverse, with
  equal values between them left out.
* A signal has settled when it stays in a band around its last value; the settling
  time runs from the first sample to the first one after which it never leaves the
  band (0 if it never does).
* Resource efficiency is the used share of the cpu time provided.

Samples are ordered by (ts, seq).  Rows without a time or a value are left out; a
null key is a series.  Long series run in parts with a row of their neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import CHUNK_ROWS, by_chunks, dense_position, join_null_safe

# Fixed value: half width of the band, as a share of the last value.
BAND = 0.05


def oscillations(df: DataFrame, keys, value: str, order=("ts", "seq"), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """keys and ``oscillation_count``."""
    keys, order = list(keys), list(order)
    d = df.where(F.col(order[0]).isNotNull() & F.col(value).isNotNull()).select(*keys, *order, F.col(value).alias("_v"))

    def moved(rows, parts):
        w = Window.partitionBy(*parts).orderBy("_p")
        return rows.withColumn("_d", F.signum(F.col("_v").cast("double") - F.lag("_v").over(w).cast("double")))

    def turned(rows, parts):
        w = Window.partitionBy(*parts).orderBy("_q")
        return rows.withColumn("_t", F.lag("_d").over(w) != F.col("_d"))

    steps = by_chunks(dense_position(d, keys, order, "_p", chunk_rows), keys, "_p", 1, moved, chunk_rows)
    moves = dense_position(steps.where(F.col("_d") != 0), keys, ["_p"], "_q", chunk_rows)  # the flat steps are left out
    turns = by_chunks(moves, keys, "_q", 1, turned, chunk_rows).groupBy(*keys).agg(F.count_if("_t").alias("_n"))
    return join_null_safe(d.select(*keys).distinct(), turns, keys, "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("oscillation_count"))


def settling_time(df: DataFrame, keys, value: str, order=("ts", "seq"), band: float = BAND) -> DataFrame:
    """keys, ``final_value``, ``settled_at`` and ``settling_seconds``.  Aggregates only:
    the last sample outside the band is a maximum, the next one a minimum."""
    keys, order = list(keys), list(order)
    at = F.struct(*order)
    d = df.where(F.col(order[0]).isNotNull() & F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    ends = d.groupBy(*keys).agg(F.max_by("_v", at).alias("final_value"), F.min(order[0]).alias("_first"))
    d = join_null_safe(d, ends, keys)
    outside = F.abs(F.col("_v") - F.col("final_value")) > F.abs(F.col("final_value")) * band
    last = d.groupBy(*keys).agg(F.max(F.when(outside, at)).alias("_out"))
    inside = F.col("_out").isNull() | (at > F.col("_out"))
    out = join_null_safe(d, last, keys).groupBy(*keys).agg(
        F.first("final_value").alias("final_value"), F.first("_first").alias("_first"), F.min(F.when(inside, F.col(order[0]))).alias("settled_at"))
    us = F.unix_micros(F.col("settled_at").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return out.select(*keys, "final_value", "settled_at", (us / 1e6).alias("settling_seconds"))


def resource_efficiency(df: DataFrame, keys, cores: str = "cpu_cores", utilization: str = "cpu_utilization", hours: str = "elapsed_hours") -> DataFrame:
    """keys and ``resource_efficiency``: core hours used over core hours provided, where
    utilization is a share; null where none were provided."""
    used = F.sum(F.col(cores) * F.col(utilization) * F.col(hours))
    held = F.sum(F.when(F.col(utilization).isNotNull(), F.col(cores) * F.col(hours)))
    return df.groupBy(*keys).agg(F.try_divide(used, held).alias("resource_efficiency"))


def signal_stability(samples: DataFrame, keys=("experiment_id",), replicas: str = "replica_count", load: str = "cpu_utilization",
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The three measures of strategy samples: reversals of the replica count, settling
    of the load, efficiency."""
    out = join_null_safe(oscillations(samples, keys, replicas, chunk_rows=chunk_rows), settling_time(samples, keys, load), keys, "left")
    return join_null_safe(out, resource_efficiency(samples, keys, utilization=load), keys, "left")
