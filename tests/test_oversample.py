"""F-27: exact neighbours (vs brute force) and the synthetic row count."""

import numpy as np
from pyspark.sql import functions as F

from capstan.operators.oversample import nearest_neighbours, oversample


def test_neighbours_exact_and_counts(spark):
    rng = np.random.default_rng(7)
    pts = rng.normal(0, 1, (300, 3))
    pts[:40] = pts[:40] * 0.01            # a tight cluster: forces a finer grid
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "_id long, _x array<double>")
    got = {r["_id"]: [e["id"] for e in r["nn"]] for r in nearest_neighbours(df, 4).collect()}
    assert len(got) == 300
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        d[i] = np.inf
        want = sorted(range(300), key=lambda j: (d[j], j))[:4]
        assert got[i] == want, i

    lab = spark.createDataFrame([(i, float(p[0]), float(p[1]), int(i < 50)) for i, p in enumerate(pts)],
                                "event_id long, a double, b double, y int")
    out = oversample(lab, ["a", "b"], "y", k=5)
    c = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert c[1] == c[0] == 250
    syn = out.where("synthetic")
    assert syn.count() == 200
    lo = lab.where("y = 1").agg(F.min("a"), F.max("a")).first()
    rng_a = syn.agg(F.min("a"), F.max("a")).first()
    assert lo[0] - 1e-12 <= rng_a[0] and rng_a[1] <= lo[1] + 1e-12


def test_ties_and_more_features_than_grid_axes(spark):
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(0, 1, (200, 5)), 1)
    pts[:60] = pts[0]                     # a third of the rows at one point
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "_id long, _x array<double>")
    got = {r["_id"]: [e["id"] for e in r["nn"]] for r in nearest_neighbours(df, 5).collect()}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        d[i] = np.inf
        assert len(set(got[i])) == 5 and i not in got[i]
        assert np.allclose([d[j] for j in got[i]], np.sort(d)[:5]), i


def test_slices_of_blocks_and_no_shuffled_pairs(spark, monkeypatch):
    from capstan.operators import oversample as ov

    rng = np.random.default_rng(11)
    pts = np.round(np.r_[rng.normal(0, 1, (150, 2)), rng.normal(40, 9, (30, 2))], 1)
    pts[:50] = pts[0]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "_id long, _x array<double>")
    monkeypatch.setattr(ov, "BLOCK_POINTS", 20)
    out = nearest_neighbours(df, 4)
    got = {r["_id"]: [e["id"] for e in r["nn"]] for r in out.collect()}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == sorted(range(len(pts)), key=lambda j: (d[j], j))[:4], i


def test_rows_of_one_id_still_fill_the_minority(spark):
    rows = [(7 if i < 4 else i, float(i % 3), float(i), int(i < 6)) for i in range(40)]
    lab = spark.createDataFrame(rows, "event_id long, a double, b double, y int")
    out = oversample(lab, ["a", "b"], "y", k=5).groupBy("y", "synthetic").count().collect()
    assert sorted((r["y"], r["synthetic"], r["count"]) for r in out) == [(0, False, 34), (1, False, 6), (1, True, 28)]
