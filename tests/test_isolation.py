"""Isolation scores: planted outliers (extreme in both columns) first, reruns equal, defined results for nulls."""

import numpy as np
import pytest

from capstan.operators import isolation


def frame(spark, n=3000):
    r = np.random.default_rng(5)
    rows = [(k, float(a), float(b), 1.0) for k, (a, b) in enumerate(r.normal(size=(n, 2)))]
    rows += [(n + k, *at, 1.0) for k, at in enumerate([(12.0, -12.0), (-12.0, 12.0), (12.0, 12.0), (-12.0, -12.0)])] + [(n + 10, None, 0.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, same double").repartition(4).cache()


def test_planted_outliers_rank_first_and_reruns_agree(spark):
    df = frame(spark)
    forest = isolation.fit_isolation(df, ["a", "b", "same"], trees=100, rows=256)
    out = {r["id"]: r["isolation_score"] for r in isolation.isolation_scores(df, forest).collect()}
    assert out.pop(3010) is None
    top = sorted(out, key=out.get, reverse=True)[:4]
    assert set(top) == {3000, 3001, 3002, 3003}
    assert all(0 < s < 1 for s in out.values()) and np.median(list(out.values())) < 0.5
    again = isolation.fit_isolation(df, ["a", "b", "same"], trees=100, rows=256)
    assert np.array_equal(forest.cut, again.cut) and np.array_equal(forest.low, again.low)


def test_paths_match_a_walk(spark):
    df = frame(spark, 200)
    forest = isolation.fit_isolation(df, ["a", "b"], trees=5, rows=32)
    for r in isolation.isolation_scores(df, forest).where("a IS NOT NULL").limit(40).collect():
        total = 0.0
        for node in forest.roots:
            while forest.low[node] != node:
                node = forest.low[node] if (r["a"], r["b"])[forest.feature[node]] < forest.cut[node] else forest.high[node]
            total += forest.path[node]
        assert r["isolation_score"] == pytest.approx(2 ** (-total / 5 / isolation.average_path(32)))
    assert isolation.average_path(1) == 0.0 and isolation.average_path(2) == 1.0


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, a double")
    out = {r["id"]: r["isolation_score"] for r in isolation.isolation_scores(df, isolation.fit_isolation(df, ["a"], trees=3)).collect()}
    assert out[1] == out[2] and out[3] is None
    empty = isolation.fit_isolation(df.limit(0), ["a"])
    assert [r["isolation_score"] for r in isolation.isolation_scores(df, empty).collect()] == [None] * 3
