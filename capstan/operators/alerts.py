"""Alert rules with a hold time: ``value > threshold`` for so long.

A sample's value stands until the next sample of its series, but no longer than
``stale``; equal times of a series count as one sample with their greatest value.
A condition begins with the first sample above the threshold and ends with the
first sample that is not, or when the value goes stale.  Events of a condition:

* ``pending`` when it begins;
* ``firing`` when it has held for ``hold`` and still holds;
* ``resolved`` when it ends after firing, ``inactive`` when it ends before.

Rows without a time or a value are no samples; a null key is a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import CHUNK_ROWS, by_chunks_both, dense_position, sum_before

# The rule for high cpu usage.
CPU_PERCENT_LIMIT, CPU_HOLD = 80.0, "5 minutes"


def conditions(samples: DataFrame, keys=("service",), threshold: float = CPU_PERCENT_LIMIT, stale: str = "5 minutes",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per series and condition: ``since`` and ``until``.  Long series run in chunks
    with a row of their neighbours."""
    keys = list(keys)
    d = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    d = d.groupBy(*keys, F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").alias("value"))
    gap = F.expr(f"INTERVAL {stale}")

    def mark(rows: DataFrame, parts) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy("ts")
        above, before, after = F.col("value") > threshold, F.lag("ts").over(w), F.lead("ts").over(w)
        goes_on = F.coalesce((F.lag("value").over(w) > threshold) & (F.col("ts") <= before + gap), F.lit(False))
        stale_at = F.col("ts") + gap
        until = F.when(after.isNull() | (after > stale_at), stale_at).when(~(F.lead("value").over(w) > threshold), after)
        return rows.select("*", above.alias("_above"), (above & ~goes_on).cast("long").alias("_begins"), until.alias("_until"))

    d = by_chunks_both(dense_position(d, keys, ["ts"], "_apos", chunk_rows), keys, "_apos", 1, mark, chunk_rows)
    d = sum_before(d.where("_above"), keys, ["ts"], "_begins", "_island", chunk_rows)
    island = (F.col("_island") + F.col("_begins")).alias("_island")
    return d.groupBy(*keys, island).agg(F.min("ts").alias("since"), F.max("_until").alias("until")).drop("_island")


def alert_events(samples: DataFrame, keys=("service",), threshold: float = CPU_PERCENT_LIMIT, hold: str = CPU_HOLD, stale: str = "5 minutes",
                 upto: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row an event: keys, ``state``, ``at`` and ``since`` (when its condition
    began).  ``upto``: only events until that time are known."""
    c = conditions(samples, keys, threshold, stale, chunk_rows)
    fires = F.col("since") + F.expr(f"INTERVAL {hold}")
    fired = F.col("until") > fires
    events = F.array(
        F.struct(F.lit("pending").alias("state"), F.col("since").alias("at")),
        F.when(fired, F.struct(F.lit("firing").alias("state"), fires.alias("at"))),
        F.struct(F.when(fired, "resolved").otherwise("inactive").alias("state"), F.col("until").alias("at")))
    out = c.select(*keys, F.inline(F.array_compact(events)), "since")
    return out if upto is None else out.where(F.col("at") <= upto)
