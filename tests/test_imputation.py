"""Iterative imputation against plain least squares in numpy."""

import numpy as np
import pytest

from capstan.operators import imputation


def plain(x, rounds):
    held = ~np.isnan(x)
    y = np.where(held, x, np.nanmean(x, axis=0))
    for _ in range(rounds):
        new = y.copy()
        for j in range(x.shape[1]):
            a = np.column_stack([np.ones(len(y)), np.delete(y, j, axis=1)])
            beta = np.linalg.lstsq(a[held[:, j]], x[held[:, j], j], rcond=None)[0]
            new[~held[:, j], j] = (a @ beta)[~held[:, j]]
        y = new
    return y


def frame(spark, x, parts=3):
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, `d.e` double").repartition(parts)


NAMES = ["a", "b", "c", "d.e"]


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_fills_match_numpy(spark, rounds):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + [1e5, 0, -3, 10]
    x[r.random(x.shape) < 0.25] = np.nan
    df = frame(spark, x)
    out = imputation.iterative_impute(df, NAMES, rounds)
    got = np.array([[v[c] for c in NAMES] for v in sorted(out.collect(), key=lambda v: v["id"])], float)
    assert out.columns == df.columns and np.allclose(got, plain(x, rounds), rtol=1e-8, atol=1e-6)
    assert np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)])  # held values stay as they are


def test_a_linear_rule_is_recovered(spark):
    a = np.arange(200.0)
    x = np.column_stack([a, 2 * a + 5, np.where(a % 5 == 0, np.nan, 7 - 3 * a), np.full(200, 4.0)])
    got = {v["id"]: v["c"] for v in imputation.iterative_impute(frame(spark, x), NAMES).collect()}
    assert all(abs(got[k] - (7 - 3 * k)) < 1e-6 for k in range(200))


def test_empty_columns_rows_and_tables(spark):
    x = np.array([[1, 2, np.nan, np.nan], [np.nan] * 4, [3, np.nan, np.nan, 9], [5, 6, np.nan, np.nan]])
    rows = {v["id"]: v for v in imputation.iterative_impute(frame(spark, x), NAMES, 3).collect()}
    assert all(v["c"] is None and None not in (v["a"], v["b"], v["d.e"]) for v in rows.values())
    assert rows[1]["a"] == pytest.approx(3.0) and all(v["d.e"] == pytest.approx(9.0) for v in rows.values())
    assert imputation.iterative_impute(frame(spark, x).limit(0), NAMES).count() == 0
    ints = spark.createDataFrame([(1, 2.0), (None, 4.0), (3, float("nan"))], "n int, v double")
    got = [(v["n"], v["v"]) for v in imputation.iterative_impute(ints, ["n", "v"], 1).collect()]
    assert all(v is not None and not np.isnan(v) for r in got for v in r)
