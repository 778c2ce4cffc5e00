"""Drift, moments, feature selection, signal stability and grants against numpy and
plain loops, with null keys, ties, empty tables and series split in parts."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.operators import allocation, drift, moments, selection, settling

T0 = dt.datetime(2024, 1, 1)


def ks_of(a, b):
    return max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in set(a) | set(b))


def psi_of(a, b):
    edges = np.quantile(a, [i / 10 for i in range(1, 10)])
    bins = [np.searchsorted(edges, x, side="left") for x in (a, b)]
    out = 0.0
    for k in set(bins[0]) | set(bins[1]):
        p, q = (max(np.mean(x == k), 1e-4) for x in bins)
        out += (q - p) * math.log(q / p)
    return out


@pytest.mark.parametrize("chunk_rows", [1_000_000, 16])
def test_drift_matches_numpy(spark, chunk_rows):
    r = random.Random(1)
    groups = {("a", "x"): ([r.gauss(0, 1) for _ in range(300)], [r.gauss(0.6, 1) for _ in range(200)]),
              (None, "ties"): ([float(r.randrange(5)) for _ in range(150)], [float(r.randrange(5)) for _ in range(90)]),
              ("b", None): ([1.0] * 40, [1.0] * 30), ("only", "ref"): ([1.0, 2.0], []), ("only", "cur"): ([], [1.0])}
    schema = "service string, feature string, value double"
    ref, cur = (spark.createDataFrame([(*k, v) for k, x in groups.items() for v in x[i]] + [("a", "x", None)], schema) for i in (0, 1))
    got = {(x["service"], x["feature"]): x for x in drift.drift(ref, cur, chunk_rows=chunk_rows).collect()}
    assert set(got) == set(groups)
    for key, (a, b) in groups.items():
        row = got[key]
        assert (row["n_ref"], row["n_cur"]) == (len(a), len(b))
        if not a or not b:
            assert row["ks"] is None and row["psi"] is None and row["drifted"] is None and row["level"] is None
        else:
            assert row["ks"] == pytest.approx(ks_of(a, b)) and row["psi"] == pytest.approx(psi_of(a, b))
    assert got[("a", "x")]["drifted"] and got[("a", "x")]["level"] == "significant"
    assert got[("b", None)]["ks_p"] == 1.0 and got[("b", None)]["level"] == "stable"
    assert drift.drift(ref.limit(0), cur.limit(0)).count() == 0


def table(spark, n=400):
    r = random.Random(2)
    rows = []
    for k in range(n):
        x = r.gauss(1e6, 3)
        rows.append((x, 2 * x + 1, r.gauss(0, 1) if k % 5 else None, float(k % 4), 7.0, x + r.gauss(0, 30), None))
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double").repartition(5)


def test_moments_match_numpy(spark):
    rows, df = table(spark)
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    names = list("abcdef")
    cov, cor = moments.covariance(df, names), moments.correlation(df, names)
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[both, i], x[both, j])
            assert cov[i, j] == pytest.approx(want[0, 1], rel=1e-9, abs=1e-9)
            scale = math.sqrt(want[0, 0] * want[1, 1])
            assert cor[i, j] == pytest.approx(want[0, 1] / scale if scale else 0.0, abs=1e-9)
    assert np.isnan(moments.covariance(df, ["a", "g"])[1, 1]) and moments.correlation(df.limit(0), ["a", "b"]).tolist() == [[0, 0], [0, 0]]


def info_of(x, y, bins=16):
    held = ~np.isnan(x) & ~np.isnan(y)

    def place(v):
        low, high = np.nanmin(v), np.nanmax(v)
        return np.zeros(len(v)) if high == low else np.minimum(np.floor((v - low) / (high - low) * bins), bins - 1)
    a, b = place(x)[held], place(y)[held]
    out = 0.0
    for i in set(a):
        for j in set(b):
            p = np.mean((a == i) & (b == j))
            if p:
                out += p * math.log(p / (np.mean(a == i) * np.mean(b == j)))
    return out


def test_mutual_information_and_selection(spark):
    rows, df = table(spark)
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    pairs = [("a", "f"), ("c", "f"), ("d", "c"), ("e", "a"), ("a", "a")]
    got = {(r["a"], r["b"]): r["mutual_info"] for r in selection.mutual_information(df, pairs).collect()}
    for a, b in pairs:
        assert got[(a, b)] == pytest.approx(max(0.0, info_of(x[:, "abcdefg".index(a)], x[:, "abcdefg".index(b)])), abs=1e-9)
    picked = {r["feature"]: (r["reason"], r["kept_as"]) for r in selection.select_features(df, list("abcdeg"), "f").collect()}
    assert picked["a"] == ("kept", None) and picked["b"] == ("redundant", "a")
    assert picked["e"] == ("low variance", None) and picked["g"] == ("low variance", None)
    few = selection.select_features(df, list("abcd"), "f", information_limit=0.0, max_features=1)
    reasons = sorted(r["reason"] for r in few.collect())
    assert reasons.count("kept") == 1 and set(reasons) <= {"kept", "redundant", "surplus"} and "surplus" in reasons
    assert selection.mutual_information(df.limit(0), pairs).count() == 0


def stability_of(values):
    d = [np.sign(b - a) for a, b in zip(values, values[1:])]
    d = [x for x in d if x]
    turns = sum(a != b for a, b in zip(d, d[1:]))
    out = [k for k, v in enumerate(values) if abs(v - values[-1]) > abs(values[-1]) * settling.BAND]
    return turns, float((max(out) + 1) if out else 0)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 7])
def test_signal_stability_of_split_series(spark, chunk_rows):
    r = random.Random(4)
    series = {"a": [r.choice([1, 2, 2, 3]) for _ in range(100)], None: [1, 5, 5, 5, 3, 3, 3, 4, 4, 4], "flat": [2] * 20, "one": [4],
              "damped": [100 + round(60 * (-0.7) ** k) for k in range(30)]}
    rows = [(k, T0 + dt.timedelta(seconds=i), i, v, float(v), 0.5 if i % 2 else None, 1.0) for k, x in series.items() for i, v in enumerate(x)]
    schema = "experiment_id string, ts timestamp, seq long, replica_count int, load double, cpu_utilization double, cpu_cores double"
    df = spark.createDataFrame(rows + [("a", None, 0, 9, 9.0, None, None), ("a", T0, 999, None, None, None, None)], schema).repartition(4)
    turns = {x[0]: x[1] for x in settling.oscillations(df, ["experiment_id"], "replica_count", chunk_rows=chunk_rows).collect()}
    settled = {x[0]: x["settling_seconds"] for x in settling.settling_time(df, ["experiment_id"], "load").collect()}
    assert {k: (turns[k], settled[k]) for k in turns} == {k: stability_of(x) for k, x in series.items()}
    assert turns[None] == 2 and settled["damped"] > 0 and settled["flat"] == 0.0
    e = settling.resource_efficiency(df.withColumn("elapsed_hours", F.lit(2.0)), ["experiment_id"])
    assert {x[0]: x[1] for x in e.collect()} == {"a": 0.5, None: 0.5, "flat": 0.5, "one": None, "damped": 0.5}
    assert settling.oscillations(df.limit(0), ["experiment_id"], "replica_count").count() == 0


@pytest.mark.parametrize("chunk_rows", [1_000_000, 8])
def test_grants_never_pass_the_cap(spark, chunk_rows):
    r = random.Random(5)
    rows = [(r.choice(["frontend", "cartservice", "other", None]), f"c{k:03d}", r.choice([0, 10, 250, 999, None, -5])) for k in range(90)]
    df = spark.createDataFrame(rows, "service string, name string, requested long").repartition(4)
    order = {"frontend": 2, "cartservice": 3}
    for capacity in (0, 100, 9999, 10**9):
        left, want = capacity * 80 // 100, {}
        for s, name, x in sorted(rows, key=lambda x: (order.get(x[0], 6), x[0] is not None, x[0] or "", x[1])):
            x = max(x or 0, 0)
            got = min(x, left)
            left -= got
            want[name] = (order.get(s, 6), got, "granted" if got == x else "partial" if got else "refused")
        out = allocation.grants(df, capacity, chunk_rows=chunk_rows).collect()
        assert {x["name"]: (x["priority"], x["granted"], x["outcome"]) for x in out} == want
        assert sum(x["granted"] for x in out) <= capacity * 80 // 100
        assert sum(x["outcome"] == "partial" for x in out) <= 1
    assert allocation.grants(df.limit(0), 100).count() == 0
