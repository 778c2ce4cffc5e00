"""Invariants of splits, ensembles, forecasting and the power transform."""

import os

import numpy as np
from pyspark.sql import functions as F

from capstan.operators import ensemble as en
from capstan.operators import forecast as fc
from capstan.operators import grading as gr
from capstan.operators import models as md
from capstan.operators import scaling as sc
from capstan.operators import splits as sp
from capstan.operators.experiments import experiment_grid


def test_grid_size(spark):
    s = spark.createDataFrame([("svc",)], "service string")
    g = experiment_grid(s, ["browsing", "checkout"], [1, 2, 4], [10, 50, 100])
    assert g.count() == 18
    assert "svc_browsing_replicas_1_users_10" in [r[0] for r in g.select("experiment_id").collect()]


def test_folds_partition_rows(spark):
    df = spark.range(103).select(F.lit("e").alias("experiment_id"), F.col("id").alias("idx"))
    f = sp.contiguous_folds(df, 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [21, 21, 21, 20, 20]
    ef = sp.expanding_folds(df, 3)
    for i in range(3):
        rows = ef.where(F.col("fold") == i)
        test = rows.where(F.col("role") == "test").agg(F.min("idx"), F.max("idx")).first()
        train_max = rows.where(F.col("role") == "train").agg(F.max("idx")).first()[0]
        assert train_max + 1 == test[0] and test[1] - test[0] + 1 == 103 // 4
    t = sp.time_split(df).where(F.col("split") == "train").count()
    assert t == int(103 * 0.8)


def test_inverse_mse_weights_sum_to_one(spark):
    m = spark.createDataFrame([("s", "t", "a", 1.0), ("s", "t", "b", 3.0), ("s", "t", "c", 0.5)],
                              "service string, target string, model string, mse double")
    w = en.inverse_mse_weights(m).collect()
    assert abs(sum(r["weight"] for r in w) - 1.0) < 1e-12
    assert max(w, key=lambda r: r["weight"])["model"] == "c"


def test_compliance_on_trained_model_record(spark):
    rows = [("svc", "cpu_target", "success", 0.001, 0.05, 0.8, None),
            ("svc", "memory_target", "success", 1e10, 1e7, -2.0, None),
            ("svc", "replica_target", "success", 0.2, 0.15, 0.7, None)]
    r = spark.createDataFrame(rows, "service string, target string, status string, mse double, mae double, "
                                    "r2 double, confidence double")
    c = gr.compliance(r)
    assert c.where("overall_compliant").count() == 3
    assert gr.overall_score(c).first()["overall_score"] == 100.0


def _numpy_design(t):
    ts = (t - t.min()) / (t.max() - t.min())
    cols = [np.ones_like(t), ts]
    for j in range(fc.N_CHANGEPOINTS):
        cols.append(np.maximum(ts - fc.CHANGEPOINT_RANGE * (j + 1) / (fc.N_CHANGEPOINTS + 1), 0))
    for period, order in ((fc.DAY_H, fc.DAILY_ORDER), (fc.WEEK_H, fc.WEEKLY_ORDER)):
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.stack(cols, axis=1)


def test_forecast_matches_numpy_least_squares(spark):
    t = np.arange(0, 400) * 0.25
    rng = np.random.default_rng(3)
    y = 2 + 0.01 * t + 0.5 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.05, len(t))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(t, y)], "g string, t double, y double")
    out = fc.seasonal_forecast(df, ["g"], "t", "y", horizon=5, step=0.25)
    hist = out.where(~F.col("future")).orderBy("t").toPandas()
    x = _numpy_design(t)
    a = x.T @ x
    reg = fc.RIDGE * max(1.0, np.trace(a) / a.shape[0])
    beta = np.linalg.solve(a + reg * np.eye(a.shape[0]), x.T @ y)
    assert np.max(np.abs(hist["yhat"].to_numpy() - x @ beta)) < 1e-6
    resid = y - x @ beta
    sigma = np.sqrt(resid @ resid / (len(y) - a.shape[0]))
    assert abs((hist["yhat_upper"] - hist["yhat"]).iloc[0] - fc.Z_90 * sigma) < 1e-6
    assert out.where("future").count() == 5


def test_yeo_johnson_lambda_matches_grid_search(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 0.6, 400)
    df = spark.createDataFrame([("e", float(v)) for v in x], "experiment_id string, v double")
    lam = sc.yeo_johnson_lambda(df, "v").first()["lam"]

    def ll(lmb):
        yj = ((x + 1) ** lmb - 1) / lmb if abs(lmb) > 1e-12 else np.log1p(x)
        return -len(x) / 2 * np.log(np.var(yj)) + (lmb - 1) * np.sum(np.log1p(x))
    grid = np.arange(-2, 4.0001, 0.001)
    best = grid[np.argmax([ll(g) for g in grid])]
    assert abs(lam - best) < 0.02


def _points(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.05, n)
    rows = [("ab"[i % 2], i, float(x[i, 0]), float(x[i, 1]), float(y[i]), int(y[i] > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "service string, idx long, a double, b double, y double, c int")


def test_forest_and_boosted_explain_a_plain_target(spark):
    d = _points(spark)
    tr, te = d.where("idx < 180"), d.where("idx >= 180")
    for fit in (md.rf_regressor, md.boosted_regressor):
        m, pred = fit(tr, te, ["a", "b"], "y", params={"maxDepth": 5})
        p = pred.toPandas()
        assert len(p) == 60 and np.corrcoef(p["y"], p["prediction"])[0, 1] > 0.9
        imp = {r["feature"]: r["importance"] for r in md.feature_importance(m, ["a", "b"], "m", spark).collect()}
        assert abs(sum(imp.values()) - 1) < 1e-9 and imp["a"] > imp["b"]


def test_trees_are_fitted_on_all_rows_in_parts_of_even_size(spark, monkeypatch):
    d = _points(spark).withColumn("text", F.lit("x")).repartition(1)
    monkeypatch.setattr(md, "FIT_FILE_ROWS", 50)
    for fit, model in ((md.rf_regressor, "RandomForestRegressor"), (md.boosted_regressor, "GBTRegressor")):
        parts, est = [], getattr(md, model)
        plain = est.fit
        monkeypatch.setattr(est, "fit", lambda self, x, plain=plain, parts=parts: parts.append(
            [[r["y"] for r in p] for p in x.rdd.glom().collect()]) or plain(self, x))
        fit(d.where("service = 'a'"), d, ["a", "b"], "y", params={"maxDepth": 2})
        # one part of 120 rows had one task a pass
        assert sorted(map(len, parts[0])) == [20, 50, 50]
        assert sorted(v for p in parts[0] for v in p) == sorted(r["y"] for r in d.where("service = 'a'").collect())


def test_failed_service_is_visible(spark):
    d = _points(spark)

    def fit(part, service):
        if service == "b":
            raise ValueError("no rows fit " + "x" * 300)
        return part

    preds, status = md.train_per_service(d, ["a", "b"], fit)
    got = {r["service"]: r for r in status.collect()}
    assert len(preds) == 1 and got["a"]["status"] == "success" and got["b"]["status"] == "failed"
    assert got["b"]["error"].endswith("x" * 300)


def test_stack_equals_numpy_per_key_and_skips_missing_predictions(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s, scale in (("a", 1.0), ("b", 1e6)):
        y = rng.normal(5, 2, 80) * scale
        p = np.stack([y + rng.normal(0, scale, 80), 0.5 * y + rng.normal(0, scale, 80)], axis=1)
        keep = [i for i in range(80) if not (s == "a" and i == 7)]
        for i in range(80):
            rows += [(s, "t", m, i, float(y[i]), float(p[i, k])) for k, m in enumerate(("m1", "m2")) if not (k == 1 and i not in keep)]
        cut = len(keep) // 2
        x = np.c_[np.ones(cut), p[keep[:cut]]]
        w = np.linalg.lstsq(x, y[keep[:cut]], rcond=None)[0]
        want |= {(s, i): w[0] + p[i] @ w[1:] for i in keep[cut:]}
    df = spark.createDataFrame(rows, "service string, target string, model string, idx long, y_true double, y_pred double")
    got = {(r["service"], r["idx"]): r["y_pred"] for r in md.stack(df, ["m1", "m2"]).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_search_returns_a_fitted_model(spark):
    d = _points(spark)
    tr, te = d.where("idx < 180"), d.where("idx >= 180")
    res = md.rf_classifier_search(tr, ["a", "b"], "c", [(tr.where("idx < 90"), tr.where("idx >= 90"))], n_iter=2,
                                  space={"numTrees": [5, 10], "maxDepth": [3]}, max_rows=60)
    m = md.score_classifier(res["model"], md.assemble(te, ["a", "b"]), "c")
    assert set(res["params"]) == {"numTrees", "maxDepth"} and len(res["scores"]) == 2
    assert m["accuracy"] > 0.8 and m["roc_auc"] > 0.9 and m["tp"] + m["fp"] + m["tn"] + m["fn"] == 60


def test_autoregression_and_its_classifier(spark):
    rows = [(i, [[np.sin(i / 3 + k / 3)] for k in range(6)], float(np.sin(i / 3 + 2)), int(np.sin(i / 3 + 2) > 0)) for i in range(200)]
    s = spark.createDataFrame([(i, [[float(v) for v in r] for r in q], t, c) for i, q, t, c in rows],
                              "idx long, sequence array<array<double>>, target double, y_class int")
    tr, te = s.where("idx < 150"), s.where("idx >= 150")
    p = md.autoregressive(tr, te)[1].toPandas()
    assert np.abs(p["prediction"] - p["target"]).max() < 0.1
    q = md.autoregressive_classifier(tr, te)[1].toPandas()
    assert ((q["proba"] > 0.5) == (q["y_class"] == 1)).mean() > 0.9


def test_search_fits_equal_draws_once_and_stores_no_fold_scores(spark, monkeypatch):
    fits, stored = [], []
    fit, store = md.RandomForestClassifier.fit, md.scratch_table
    monkeypatch.setattr(md.RandomForestClassifier, "fit", lambda self, d: fits.append(1) or fit(self, d))
    monkeypatch.setattr(md, "scratch_table", lambda d, label="table": stored.append(label) or store(d, label))
    d = _points(spark)
    res = md.rf_classifier_search(d, ["a", "b"], "c", [(d.where("idx < 90"), d.where("idx >= 90"))], n_iter=4,
                                  space={"numTrees": [5], "maxDepth": [3]}, max_rows=60)
    assert len(fits) == 2 and len(res["scores"]) == 4 and len(set(res["scores"])) == 1 and "scored" not in stored
    tr, va = md.assemble(d.where("idx < 90"), ["a", "b"]), md.assemble(d.where("idx >= 90"), ["a", "b"])
    m = md.RandomForestClassifier(featuresCol="features", labelCol="c", seed=md.SEED, maxMemoryInMB=512, **res["params"]).fit(
        md.bounded_rows(tr, 60, "c").coalesce(1))
    assert abs(md.score_classifier(m, va, "c")["f1"] - res["f1"]) < 0.05


def test_search_fits_all_labelled_rows_in_parts_of_trees(spark, monkeypatch):
    # 900 labelled rows of 1,000; the fits saw a sample of 500 at the most
    d = _points(spark, 1000).withColumn("c", F.when(F.col("idx") % 10 != 9, F.col("c")))
    fits, fit = [], md.RandomForestClassifier.fit

    def counted(self, x):
        m = fit(self, x)
        fits.append((x.rdd.getNumPartitions(), x.where("c IS NOT NULL").count(), m.getNumTrees, self.getSeed(), m))
        return m

    monkeypatch.setattr(md.RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(md, "TREE_ROWS", 1800)
    res = md.rf_classifier_search(d, ["a", "b"], "c", [(d.where("idx < 800"), d.where("idx >= 800"))], n_iter=1, space={"numTrees": [5], "maxDepth": [20]})
    assert sorted(f[1:3] for f in fits) == [(720, 1), (720, 2), (720, 2), (900, 1), (900, 2), (900, 2)]
    assert len({f[3] for f in fits if f[1] == 900}) == 3
    te = md.assemble(d.where("c IS NOT NULL"), ["a", "b"])
    got = {r["idx"]: r["probability"][1] for r in res["model"].transform(te).collect()}
    want = dict.fromkeys(got, 0.0)
    for *_, m in [f for f in fits if f[1] == 900]:
        for r in m.transform(te).collect():
            want[r["idx"]] += r["rawPrediction"][1] / 5
    assert len(got) == 900 and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_draws_that_differ_in_trees_alone_share_the_first_ones(spark, monkeypatch):
    d = _points(spark)
    tr, va = d.where("idx < 180"), d.where("idx >= 180")
    fits, fit = [], md.RandomForestClassifier.fit
    monkeypatch.setattr(md.RandomForestClassifier, "fit", lambda self, x: fits.append((self.getNumTrees(), self.getCacheNodeIds())) or fit(self, x))
    space = {"numTrees": [3, 5], "maxDepth": [2]}
    res = md.rf_classifier_search(d, ["a", "b"], "c", [(tr, va)], n_iter=6, space=space)
    rnd = md.random.Random(md.SEED)
    draws = [{k: rnd.choice(v) for k, v in space.items()}["numTrees"] for _ in range(6)]
    assert set(draws) == {3, 5}
    # a fold fits 3 and 2 trees, not 3 and 5; the last fit is the best draw's
    assert [n for n, _ in fits[:2]] == [3, 2] and sum(n for n, _ in fits[2:]) == res["params"]["numTrees"] and all(c for _, c in fits)
    x, v = md.assemble(tr, ["a", "b"]).coalesce(1), md.assemble(va, ["a", "b"])
    est = lambda n, seed: fit(md.RandomForestClassifier(featuresCol="features", labelCol="c", seed=seed, maxMemoryInMB=512, maxDepth=2, numTrees=n), x)
    one, two = est(3, md.SEED), est(2, md.SEED + 3 * 1_000_003)
    truth = {r["idx"]: r["c"] for r in v.collect()}
    votes = {3: {r["idx"]: r["rawPrediction"][1] for r in one.transform(v).collect()}}
    votes[5] = {r["idx"]: votes[3][r["idx"]] + r["rawPrediction"][1] for r in two.transform(v).collect()}
    for n, score in zip(draws, res["scores"]):
        hit = {i for i, s in votes[n].items() if s / n > 0.5}
        tp = sum(truth[i] for i in hit)
        assert abs(score - 2 * tp / (len(hit) + sum(truth.values()))) < 0.05


def test_parts_of_a_forest_hold_all_its_trees(monkeypatch):
    assert md.forest_parts([500], 100) == [(0, 500)]
    for marks, n in (([300], 7929), ([300, 500], 79_290), ([5], 10**9), ([3, 7], 10)):
        parts = md.forest_parts(marks, n)
        assert sum(k for _, k in parts) == marks[-1] and [f for f, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]
        assert all(k == 1 or k * n <= md.TREE_ROWS for _, k in parts) and {f + k for f, k in parts} >= set(marks)


def test_a_stored_table_is_dropped_alone(spark):
    from capstan import session

    a, b = (session.scratch_table(spark.range(5), "drop") for _ in range(2))
    n, files = len(session._scratch), a.inputFiles()
    session.drop_table(a)
    assert len(session._scratch) == n - 1 and b.count() == 5 and not any(os.path.exists(f.removeprefix("file://")) for f in files)
