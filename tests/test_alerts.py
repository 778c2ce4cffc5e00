"""Alert events: batch against brute force, stream against batch."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from capstan.operators.alerts import alert_events
from capstan.streaming.alerts import run_alerts, stream_alerts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "service string, ts timestamp, value double"
RULE = dict(threshold=80.0, hold="5 minutes", stale="7 minutes")


def brute(rows, threshold=80.0, hold=5, stale=7):
    """Events by stepping through the changes of one series at a time, in minutes."""
    out, series = [], {}
    for s, m, v in rows:
        if m is not None and v is not None:
            series.setdefault(s, {})[m] = max(v, series.get(s, {}).get(m, v))
    for s, at in series.items():
        marks = sorted(at)
        k = 0
        while k < len(marks):
            if at[marks[k]] <= threshold:
                k += 1
                continue
            since = marks[k]
            while True:
                nxt = marks[k + 1] if k + 1 < len(marks) else None
                if nxt is None or nxt > marks[k] + stale:
                    end = marks[k] + stale
                elif at[nxt] <= threshold:
                    end = nxt
                else:
                    k += 1
                    continue
                break
            out.append((s, "pending", since, since))
            if end > since + hold:
                out += [(s, "firing", since + hold, since), (s, "resolved", end, since)]
            else:
                out.append((s, "inactive", end, since))
            k += 1
    return sorted(out, key=repr)


def minutes(df):
    return sorted(((r["service"], r["state"], (r["at"] - T0).total_seconds() / 60, (r["since"] - T0).total_seconds() / 60) for r in df.collect()), key=repr)


def made(seed, n, services=("a", "b", None)):
    r = random.Random(seed)
    rows = [(r.choice(services), float(r.randrange(400)), r.choice([10.0, 80.0, 81.0, 95.0, 99.0])) for _ in range(n)]
    return rows + [("a", None, 99.0), ("a", 3.0, None), ("c", 1.0, 90.0), ("d", 2.0, 90.0), ("d", 7.0, 20.0), ("e", 0.0, 90.0), ("e", 7.0, 90.0), ("e", 15.0, 90.0)]


def frame(spark, rows):
    return spark.createDataFrame([(s, None if m is None else T0 + dt.timedelta(minutes=m), v) for s, m, v in rows], SCHEMA)


def test_batch_equals_brute_force(spark):
    rows = made(1, 300)
    want = [tuple(map(lambda x: float(x) if isinstance(x, int) else x, e)) for e in brute(rows)]
    assert minutes(alert_events(frame(spark, rows), **RULE)) == want
    assert minutes(alert_events(frame(spark, rows), chunk_rows=16, **RULE)) == want  # long series in parts
    upto = T0 + dt.timedelta(minutes=100)
    assert minutes(alert_events(frame(spark, rows), upto=F.lit(upto), **RULE)) == [e for e in want if e[2] <= 100]
    assert alert_events(frame(spark, []), **RULE).count() == 0


def test_stream_equals_batch_with_disorder_and_gaps(spark):
    rows = made(2, 240)
    timed = sorted((x for x in rows if x[1] is not None), key=lambda x: x[1])
    r = random.Random(3)
    timed.sort(key=lambda x: x[1] + r.uniform(0, 20))  # out of order by less than the delay
    d = tempfile.mkdtemp(prefix="capstan-alerts-")
    for k in range(0, len(timed), 60):
        frame(spark, timed[k:k + 60]).coalesce(1).write.parquet(os.path.join(d, f"b={k:04d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    got = run_alerts(stream, T0 + dt.timedelta(minutes=400), delay="1 hour", **RULE)
    assert minutes(got) == [tuple(map(lambda x: float(x) if isinstance(x, int) else x, e)) for e in brute(rows)]


def test_samples_behind_the_watermark_change_nothing(spark):
    d = tempfile.mkdtemp(prefix="capstan-alerts-")
    parts = [[("a", 0.0, 90.0), ("a", 4.0, 90.0), ("a", 8.0, 90.0), ("z", 300.0, 1.0)], [("z", 301.0, 1.0)], [("a", 2.0, 1.0), ("z", 302.0, 1.0)]]
    for k, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.parquet(os.path.join(d, f"b={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    got = run_alerts(stream, T0 + dt.timedelta(minutes=302), delay="10 minutes", **RULE)
    assert minutes(got.where("state <> 'late'")) == [tuple(map(lambda x: float(x) if isinstance(x, int) else x, e)) for e in brute(parts[0])]
    late = got.where("state = 'late'").collect()
    assert [(r["service"], r["at"], r["since"]) for r in late] == [("a", T0 + dt.timedelta(minutes=2), None)]
    assert stream_alerts(stream, **RULE).isStreaming


def test_state_is_read_and_written_by_block():
    import pandas as pd

    from capstan.streaming import alerts

    calls, timers = [], set()

    class State(dict):
        def keys(self):
            return [*super().keys()]

        def getValue(self, k):
            calls.append(k)
            return self.get(k)

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        def removeKey(self, k):
            calls.append(k)
            del self[k]

    class Value:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, v):
            self.kept = v

    class Handle:
        getMapState = lambda self, *_: State()
        getValueState = lambda self, *_: Value()
        registerTimer, deleteTimer = timers.add, timers.discard

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    minute, n = 60_000_000, 20_000
    rule = alerts._rule(["service"], 80.0, 5 * minute, 7 * minute)
    rule.init(Handle())
    at = [k * minute // 100 for k in range(n)]  # 200 minutes
    rows = pd.DataFrame({"at": at, "value": [90.0 if k // 2000 % 2 == 0 else 10.0 for k in range(n)]}).sample(frac=1.0, random_state=1)
    assert list(rule.handleInputRows(("a",), iter([rows[:n // 2], rows[n // 2:]]), At(0))) == []
    (due,) = timers
    out = pd.concat(rule.handleExpiredTimer(("a",), At(150 * 60_000), due))
    out = pd.concat([out, *rule.handleExpiredTimer(("a",), At(300 * 60_000), 0)])
    assert [(s, t / minute) for s, t in zip(out["state"], out["at"])] == [
        (s, t) for k in range(5) for s, t in (("pending", 40.0 * k), ("firing", 40.0 * k + 5), ("resolved", 40.0 * k + 20))]
    assert len(calls) < 150
