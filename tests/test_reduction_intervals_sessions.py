"""Components against numpy, interval joins and sessions against plain loops."""

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.operators import intervals, reduction
from capstan.streaming import sessions

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("standardize", [True, False])
def test_components_match_numpy(spark, standardize):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4)) @ r.normal(size=(4, 4)) + [1e6, 0, -5, 3]
    df = spark.createDataFrame([(*map(float, v), 2.0) for v in x], "a double, b double, c double, d double, e double").repartition(4)
    got = reduction.principal_components(df, list("abcd"), 3, standardize)
    cov = np.corrcoef(x.T) if standardize else np.cov(x.T)
    values, vectors = np.linalg.eigh(cov)
    assert np.allclose(got.variances, values[::-1][:3]) and got.total == pytest.approx(np.trace(cov))
    assert all(abs(abs(row @ vectors[:, -1 - k]) - 1) < 1e-8 and row[0] > 0 for k, row in enumerate(got.loadings))
    scores = np.array([[v[f"pc{k}"] for k in (1, 2, 3)] for v in got.project(df).collect()])
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-6) and np.allclose(np.cov(scores.T), np.diag(got.variances), atol=1e-6)
    rows = {v["component"]: v for v in got.table(spark).collect()}
    assert rows[1]["share"] == pytest.approx(values[-1] / np.trace(cov)) and len(rows) == 3
    assert reduction.principal_components(df, ["a", "e"]).variances[1] == 0.0  # a constant column
    assert reduction.principal_components(df.limit(0), ["a", "b"]).variances.tolist() == [0.0, 0.0]
    holed = df.select(F.when(F.col("a") > 0, F.col("b")).alias("b"), F.lit(None).cast("double").alias("n"))
    assert reduction.principal_components(holed, ["b", "n"]).project(holed).where("pc1 IS NOT NULL").count() == 0


@pytest.mark.parametrize("keys", [[], ["service"]])
def test_interval_join_matches_brute_force(spark, keys):
    r = random.Random(2)
    us = lambda m: None if m is None else T0 + dt.timedelta(microseconds=m)
    points = [(r.choice(["a", "b", None]), r.choice([None, *[r.randrange(-10**9, 10**9) for _ in range(6)]]), k) for k in range(300)]
    spans = []
    for k in range(120):
        s = r.randrange(-10**9, 10**9)
        spans.append((r.choice(["a", None]), s, s + r.choice([-5, 0, 1, 2, 1000, 10**6, 2**20, 2**20 + 1, 10**9, 3 * 10**9]), k))
    spans += [("a", None, 5, 900), ("a", 5, None, 901), ("a", points[0][1] or 0, (points[0][1] or 0) + 1, 902)]
    p = spark.createDataFrame([(s, us(t), k) for s, t, k in points], "service string, ts timestamp, end int").repartition(3)
    i = spark.createDataFrame([(s, us(a), us(b), k) for s, a, b, k in spans], "service string, start timestamp, end timestamp, id int")
    out = intervals.interval_join(p.withColumnRenamed("end", "n"), i, keys)
    assert out.columns == ["service", "start", "end", "id", *([] if keys else ["service"]), "ts", "n"]
    want = sorted((x[3], y[2]) for x in spans for y in points if None not in (x[1], x[2], y[1]) and x[1] <= y[1] < x[2] and (not keys or x[0] == y[0]))
    assert sorted((x["id"], x["n"]) for x in out.select("id", "n").collect()) == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(p, i.limit(0)).count() == 0 == intervals.interval_join(p.limit(0), i, keys).count()


@pytest.mark.parametrize("keys", [[], ["service"]])
def test_interval_totals_match_brute_force_without_pairs(spark, keys):
    r = random.Random(4)
    us = lambda m: None if m is None else T0 + dt.timedelta(microseconds=m)
    # a tenth of the points are no finite values; many share an instant
    points = [(r.choice(["a", "b", None]), r.choice([None, 7, *[r.randrange(-10**9, 10**9) for _ in range(6)]]),
               r.choice([None, float("inf"), -float("inf"), *[r.randrange(100) / 4 for _ in range(27)]])) for _ in range(400)]
    spans = []
    for k in range(150):
        s = r.choice([7, r.randrange(-10**9, 10**9)])
        spans.append((r.choice(["a", None]), s, s + r.choice([-5, 0, 1, 2, 10**6, 2**20, 10**7, 10**8, 10**9]), k))
    spans += [("a", None, 5, 900), ("a", 5, None, 901), spans[0]]
    p = spark.createDataFrame([(s, us(t), v) for s, t, v in points], "service string, ts timestamp, v double").repartition(3)
    i = spark.createDataFrame([(s, us(a), us(b), k) for s, a, b, k in spans], "service string, start timestamp, end timestamp, id int")
    out = intervals.interval_join(p, i, keys, value="v")
    assert out.columns == ["service", "start", "end", "id", "n", "total"]
    want = []
    for s, a, b, k in spans:
        inside = [v for q, t, v in points if None not in (a, b, t) and a <= t < b and (not keys or q == s)]
        known = [v for v in inside if v is not None]
        if inside:
            want.append((k, len(inside), repr(sum(known)) if known else "None"))
    assert sorted((x["id"], x["n"], repr(x["total"])) for x in out.collect()) == sorted(want) and len(want) > 60
    assert intervals.interval_join(p, i.limit(0), keys, value="v").count() == 0 == intervals.interval_join(p.limit(0), i, keys, value="v").count()


def sessions_of(rows, gap=10):
    out, series = [], {}
    for s, m, v in rows:
        if m is not None and v is not None:
            series.setdefault(s, []).append((m, v))
    for s, xs in series.items():
        part = []
        for m, v in sorted(xs):
            if part and m > part[-1][0] + gap:
                out.append((s, part))
                part = []
            part.append((m, v))
        out.append((s, part))
    return sorted(((s, p[0][0], p[-1][0] + gap, len(p), sum(v for _, v in p), max(v for _, v in p)) for s, p in out), key=repr)


def test_sessions_of_batch_and_stream(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), float(r.randrange(600)), float(r.randrange(9))) for _ in range(150)]
    rows += [("a", None, 1.0), ("a", 5.0, None), ("x", 0.0, 1.0), ("x", 10.0, 1.0), ("x", 19.0, 1.0), ("x", 19.0, 2.0)]
    schema = "service string, ts timestamp, value double"

    def frame(part):
        return spark.createDataFrame([(s, None if m is None else T0 + dt.timedelta(minutes=m), v) for s, m, v in part], schema)

    def got(df):
        minutes = lambda t: (t - T0).total_seconds() / 60
        return sorted(((x["service"], minutes(x["session_start"]), minutes(x["session_end"]), x["n"], x["total"], x["peak"]) for x in df.collect()), key=repr)

    assert got(sessions.batch_sessions(frame(rows))) == sessions_of(rows)
    d = tempfile.mkdtemp(prefix="capstan-sessions-")
    timed = sorted(rows, key=lambda x: (x[1] or 0) + r.uniform(0, 30))  # sessions merge across micro-batches
    for k in range(0, len(timed), 55):
        frame(timed[k:k + 55]).coalesce(1).write.parquet(os.path.join(d, f"b={k:04d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    assert got(sessions.run_sessions(stream, T0 + dt.timedelta(minutes=600))) == sessions_of(rows)
    assert sessions.batch_sessions(frame([])).count() == 0
