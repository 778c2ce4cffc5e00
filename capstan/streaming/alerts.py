"""Alert rules over a stream (see :mod:`capstan.operators.alerts`).

The state of a series is its condition and the samples that the watermark has not
passed, packed into blocks of :data:`BLOCK` of time, so that the state is read and
written by block and not by sample.  One event-time timer a series goes off at the next moment at which
something can change: the next sample, the end of the hold time, the end of a stale
value.  What lies behind the watermark is then worked off in order of time, so
samples may come in any order within the allowed delay.

The watermark moves with the samples of all series.  ``ticks`` (rows with a time and
no value) move it where no samples come; a finite run ends with one (:func:`run_alerts`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.alerts import CPU_HOLD, CPU_PERCENT_LIMIT
from ..session import scratch_path
from .late import NEVER, Windows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Microseconds of a block of waiting samples, and rows of a series that are packed at a time.
BLOCK, PACK_ROWS = 600_000_000, 1 << 20


def _merge(at, value):
    """Samples in order of time, equal times as one with their greatest value."""
    import numpy as np

    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    return at[last], value[last]


def _pack(at, value) -> bytes:
    return at.astype("<i8").tobytes() + value.astype("<f8").tobytes()


def _unpack(data: bytes):
    import numpy as np

    return np.frombuffer(data, "<i8", len(data) // 16), np.frombuffer(data, "<f8", offset=len(data) // 2)


def _rule(names: list[str], threshold: float, hold: int, stale: int):
    """Stateful processor of one rule; times are microseconds since the epoch."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Rule(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "block long", "samples binary")
            self.condition = handle.getValueState("condition", "since long, last long, fired boolean, timer long, done long, first long")

        def read(self):
            return self.condition.get() if self.condition.exists() else (None, None, False, None, NEVER, None)

        def wait(self, since, last, fired, timer, done, first, watermark):
            """Keep the condition, and a timer for the next moment of change; ``done`` is
            the time up to which the series is worked off, ``first`` that of the first
            waiting sample."""
            moments = [] if first is None else [first]
            if since is not None:
                moments += [last + stale] + ([] if fired else [since + hold])
            due = max(-(-min(moments) // 1000), watermark // 1000 + 1) if moments else None
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
            self.condition.update((since, last, fired, due, done, first))

        def put(self, at, value):
            """Add samples in order of time to their blocks."""
            blocks = at // BLOCK
            cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                block, part = (int(blocks[lo]),), (at[lo:hi], value[lo:hi])
                seen = self.waiting.getValue(block)
                if seen is not None:
                    part = _merge(*[np.concatenate(x) for x in zip(_unpack(bytes(seen[0])), part)])
                self.waiting.updateValue(block, (_pack(*part),))

        def handleInputRows(self, key, rows, timerValues):
            *state, done, first = self.read()
            held, late = [], []

            def work_off():
                nonlocal first, late
                at, value = _merge(*[np.concatenate(x) for x in zip(*held)])
                held.clear()
                behind = int(np.searchsorted(at, done, "right"))
                late += [("late", t, None) for t in at[:behind].tolist()]
                if behind < len(at):
                    first = int(at[behind]) if first is None else min(first, int(at[behind]))
                    self.put(at[behind:], value[behind:])

            for pdf in rows:
                pdf = pdf[pdf["value"].notna() & pdf["at"].notna()]
                held.append((pdf["at"].to_numpy("int64"), pdf["value"].to_numpy("float64")))
                if sum(len(x) for x, _ in held) >= PACK_ROWS:
                    work_off()
            if held:
                work_off()
            self.wait(*state, done, first, timerValues.getCurrentWatermarkInMs() * 1000)
            if late:
                yield self.rows(key, late)

        def due(self, watermark):
            """Take out the waiting samples up to the watermark, block by block; then the
            time of the first one left."""
            for block in sorted(k[0] for k in self.waiting.keys()):
                at, value = _unpack(bytes(self.waiting.getValue((block,))[0]))
                n = int(np.searchsorted(at, watermark, "right"))
                if n:
                    yield at[:n].tolist(), value[:n].tolist(), None
                if n < len(at):
                    if n:
                        self.waiting.updateValue((block,), (_pack(at[n:], value[n:]),))
                    yield [], [], int(at[n])
                    return
                self.waiting.removeKey((block,))

        def rows(self, key, events):
            out = pd.DataFrame(events, columns=["state", "at", "since"]).astype({"since": "Int64"})
            for i, name in enumerate(names):
                out.insert(i, name, key[i])
            return out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            watermark, out = timerValues.getCurrentWatermarkInMs() * 1000, []
            since, last, fired, *_ = self.read()
            first = None

            def passes(upto):
                """What happens to the condition until ``upto`` without a sample."""
                nonlocal since, fired
                if since is None:
                    return
                stop = last + stale
                if not fired and since + hold <= upto and since + hold < stop:
                    fired = True
                    out.append(("firing", since + hold, since))
                if stop < upto:
                    out.append(("resolved" if fired else "inactive", stop, since))
                    since, fired = None, False

            for times, values, first in self.due(watermark):
                for at, value in zip(times, values):
                    # a condition that ends just when its hold time does has not fired
                    passes(at if value > threshold else at - 1)
                    if value > threshold:
                        if since is None:
                            out.append(("pending", at, at))
                            since = at
                        last = at
                    elif since is not None:
                        out.append(("resolved" if fired else "inactive", at, since))
                        since, fired = None, False
                if len(out) >= PACK_ROWS:
                    yield self.rows(key, out)
                    out = []
            passes(watermark)
            self.wait(since, last, fired, None, watermark, first, watermark)
            if out:
                yield self.rows(key, out)

        def close(self):
            pass

    return Rule()


def stream_alerts(samples: DataFrame, keys=("service",), threshold: float = CPU_PERCENT_LIMIT, hold: str = CPU_HOLD, stale: str = "5 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """Alert events of a stream of (keys, ts, value).  A sample that comes when its
    series is worked off beyond its time changes nothing and gives an event ``late``.
    Needs the RocksDB state store (:func:`run_alerts` sets it)."""
    spark, keys = samples.sparkSession, list(keys)
    span = Windows.of(spark, hold, stale)
    ts = F.col("ts").cast("timestamp")
    rows = samples.select(*keys, ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("value").cast("double")).withWatermark("ts", delay)
    rows = rows.select(*keys, "at", "value")  # without the watermarked column Spark drops no row before the rule sees it
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("state", T.StringType()), T.StructField("at", T.LongType()),
                           T.StructField("since", T.LongType())])
    out = rows.groupBy(*keys).transformWithStateInPandas(_rule(keys, threshold, span.span, span.delay), schema, "Append", "EventTime")
    return out.select(*keys, "state", F.timestamp_micros("at").alias("at"), F.timestamp_micros("since").alias("since"))


def run_alerts(samples: DataFrame, upto, name: str = "alerts", base: str | None = None, **rule) -> DataFrame:
    """Alert events of a finite stream of samples, as a table.  The samples run to
    their end; then a tick, a hold time, a stale time and a delay after ``upto`` (the
    newest time; None without samples), moves the watermark past all that can still
    happen, and the run goes on from its state.  Keys are strings."""
    keys = list(rule.get("keys", ("service",)))
    after = [rule.get(k, d) for k, d in (("hold", CPU_HOLD), ("stale", "5 minutes"), ("delay", "10 minutes"))]
    return run_with_tick(lambda rows: stream_alerts(rows, **rule), samples, keys, upto, after, name, base)


def run_with_tick(build, samples: DataFrame, keys: list[str], upto, after: list[str], name: str, base: str | None = None) -> DataFrame:
    """A stateful query ``build`` over a finite stream of (keys, ts, value), complete: a
    tick beyond ``upto`` by the intervals ``after`` and an hour ends the run."""
    spark: SparkSession = samples.sparkSession
    root = base.rstrip("/") if base else scratch_path(spark, f"stream-{name}")
    samples = samples.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    beyond = " + ".join(f"INTERVAL {x}" for x in [*after, "1 hour"])
    tick = spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in keys],
                                 (F.lit(upto).cast("timestamp") + F.expr(beyond)).alias("ts"), F.lit(None).cast("double").alias("value"))
    tick.limit(0).write.mode("append").parquet(root + "/ticks")
    out = build(samples.unionByName(spark.readStream.schema(tick.schema).parquet(root + "/ticks")))
    _run(out, root)
    if upto is not None:
        tick.write.mode("append").parquet(root + "/ticks")
        _run(out, root)
    return spark.read.schema(out.schema).parquet(root + "/data")


def _run(out: DataFrame, root: str) -> None:
    spark = out.sparkSession
    kept = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", root + "/_checkpoint")
             .option("path", root + "/data").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, kept)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
