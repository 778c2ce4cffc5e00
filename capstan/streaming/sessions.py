"""Bursts of samples as session windows, in batch and as a stream.

A session of a series goes on while samples come ``gap`` or less apart; it covers the time from
its first sample to ``gap`` after its last one.  As a stream the state of a series is
its open sessions, which merge when a sample between them comes; a session is given
out when the watermark passes its end, and samples more than ``delay`` behind the
newest are dropped by Spark.  Rows without a time or a value are no samples; a null
key is a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alerts import run_with_tick


def sessions(samples: DataFrame, keys=("service",), gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """keys, ``session_start``, ``session_end``, ``n``, ``total`` and ``peak`` of each
    session of a batch or a stream of (keys, ts, value)."""
    keys = list(keys)
    rows = samples.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.withWatermark("ts", delay) if samples.isStreaming else rows
    out = rows.groupBy(*keys, F.session_window("ts", gap).alias("_w")).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    # a tick alone makes a session without samples
    return out.where(F.col("n") > 0).select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n", "total", "peak")


def batch_sessions(samples: DataFrame, keys=("service",), gap: str = "10 minutes") -> DataFrame:
    """Sessions of a table."""
    return sessions(samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull()), keys, gap)


def run_sessions(samples: DataFrame, upto, keys=("service",), gap: str = "10 minutes", delay: str = "1 hour", base: str | None = None) -> DataFrame:
    """Sessions of a finite stream, complete; ``upto`` is its newest time."""
    keys = list(keys)
    held = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return run_with_tick(lambda rows: sessions(rows, keys, gap, delay), held, keys, upto, [gap, delay], "sessions", base)
