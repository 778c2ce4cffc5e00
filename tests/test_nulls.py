"""Null labels, values and group keys."""

import datetime as dt

from pyspark.sql import functions as F

from capstan.operators import features as fe
from capstan.operators import series as se


def _rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(svc, None if svc == "a" else "x", t0 + dt.timedelta(seconds=7 * i // 3), i, None if i % gap == 1 else float(i * 13 % 50 + i))
            for svc, gap, n in (("a", 9, 120), (None, 5, 90), ("b", 2, 40), ("c", 1000, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "service string, instance string, ts timestamp, seq long, value double")


def test_rate_and_grid_in_parts_keep_null_labels_and_values(spark):
    df, keys = _rows(spark), ["service", "instance"]
    key = lambda r: (r["service"], r["instance"], r["ts"], r["seq"])
    for range_s in (20, 120):
        small = {key(r): r["rate"] for r in se.rate(df, range_s, keys, chunk_rows=16).collect()}
        plain = {key(r): r["rate"] for r in se.rate(df, range_s, keys).collect()}
        assert small.keys() == plain.keys() and any(k[0] is None for k in plain) and None in plain.values()
        assert all(small[k] is v is None or abs(small[k] - v) < 1e-9 for k, v in plain.items())
    args = ("2024-01-01 00:00:00", "2024-01-01 00:05:00", 30, 40, keys)
    rows = lambda d: sorted((str(r["service"]), str(r["instance"]), r["ts"], r["value"]) for r in d.collect())
    assert rows(se.range_eval(df, *args)) == rows(se.range_eval(df, *args, chunk_rows=16))


def test_statistics_keep_rows_of_a_null_group(spark):
    df = _rows(spark)
    out = fe.with_statistics(df, ["value"], ["service"])
    assert out.count() == df.count() and out.columns[:5] == df.columns
    mean = df.where("service is null").agg(F.avg("value")).first()[0]
    assert abs(out.where("service is null").first()["_mean_value"] - mean) < 1e-9


def _groups(spark):
    """A null group, one with a single value, one without any, and null values."""
    values = {None: [float(k * k % 17) for k in range(30)] + [None], "a": [float(k * 7 % 23) - 5 for k in range(40)], "one": [3.0], "void": [None, None]}
    rows = [(svc, i, v) for svc, vs in values.items() for i, v in enumerate(vs)]
    return values, spark.createDataFrame(rows, "service string, idx long, value double").repartition(3)


def _by_group(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["service"], {})[r["idx"]] = r[column]
    return out


def test_quantiles_of_null_groups_match_numpy(spark):
    import numpy as np

    from capstan.operators.quantiles import exact_quantiles

    values, df = _groups(spark)
    for most in (200_000, 4):  # one task a group, and brackets
        got = {r["service"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["service"], "value", [0.25, 0.9], max_bracket=most, bins=4).collect()}
        want = {s: tuple(np.quantile([x for x in v if x is not None], [0.25, 0.9])) for s, v in values.items() if s != "void"}
        assert got.keys() == want.keys() and all(np.allclose(got[s], want[s]) for s in want)


def test_features_of_null_groups(spark):
    import numpy as np

    from capstan.operators import scaling as sc

    values, df = _groups(spark)
    known = {s: [x for x in v if x is not None] for s, v in values.items()}
    filled = _by_group(fe.impute_median(df, ["value"], ["service"]), "value")
    assert filled[None][30] == np.median(known[None]) and filled["void"][0] is None and filled["a"][3] == values["a"][3]
    clipped = _by_group(fe.clip_outliers(df, ["value"], 0.1, ["service"]), "value")
    q1, q3 = np.quantile(known[None], [0.25, 0.75])
    assert np.allclose([clipped[None][k] for k in range(30)], np.clip(known[None], q1 - 0.1 * (q3 - q1), q3 + 0.1 * (q3 - q1)))
    assert len(clipped["void"]) == 2
    code = _by_group(fe.regime(df, "value", ["service"], out="code"), "code")
    assert sorted(set(code[None].values())) == [0, 1, 2]
    rank = _by_group(fe.percent_rank_avg(df, "value", ["service"], "rank"), "rank")
    assert max(x for x in rank[None].values() if x is not None) <= 1.0 and rank[None][30] is None and rank[None][0] is not None
    for method, center, width in (("robust", np.median(known[None]), np.subtract(*np.quantile(known[None], [0.75, 0.25]))),
                                  ("standard", np.mean(known[None]), np.std(known[None])), ("minmax", min(known[None]), np.ptp(known[None]))):
        out = sc.scale(df, ["value"], method, "all", ["service"])
        scaled = _by_group(out, "value_scaled")
        assert out.count() == df.count()
        assert np.allclose([scaled[None][k] for k in range(30)], (np.array(known[None]) - center) / width)
    out = sc.power_transform(df, "value", ["service"])
    power = _by_group(out, "value_power")
    assert out.count() == df.count() and abs(sum(power[None][k] for k in range(30))) < 1e-6 and power["void"] == {0: None, 1: None} == {k: power["void"][k] for k in (0, 1)}


def test_weights_profiles_and_scores_of_null_groups(spark):
    from capstan.operators import rightsize as rs
    from capstan.operators import scoring as sco
    from capstan.operators import targets as tg
    from capstan.operators.forecast import seasonal_forecast

    values, df = _groups(spark)
    cls = df.withColumn("y_class", F.when(F.col("idx") % 5 != 4, (F.col("idx") % 2).cast("int")))
    out = tg.class_weights(cls, keys=["service"])
    assert out.count() == cls.count()
    assert out.where("y_class IS NULL AND weight IS NOT NULL").count() == 0 == out.where("y_class IS NOT NULL AND weight IS NULL").count()
    p = {r["service"]: r for r in rs.usage_profile_cpu(df).collect()}
    assert p[None]["count"] == 30 and p[None]["median"] is not None and p[None]["percentile_value"] is not None
    inventory = spark.createDataFrame([(None, "n", "c", "1", "1Gi"), ("a", "n", "c", "1", "1Gi")], "service string, namespace string, container string, cpu_request string, memory_request string")
    rec = {r["service"]: r for r in rs.recommendations(inventory, df.withColumn("metric", F.lit("cpu_cores"))).collect()}
    assert rec[None]["cpu_has_data"] and rec[None]["cpu_percentile_value"] == p[None]["percentile_value"]
    pred = df.where("value IS NOT NULL").select("service", F.lit("t").alias("target"), F.lit(None).cast("string").alias("model"), "idx",
                                                F.col("value").alias("y_true"), (F.col("value") + F.col("idx")).alias("y_pred"))
    m = {r["service"]: r for r in sco.regression_metrics(pred).collect()}
    assert m[None]["median_absolute_error"] == 14.5 and m["a"]["median_absolute_error"] == 19.5
    assert "median_absolute_error" not in sco.regression_metrics(pred, median_mode=None).columns
    f = seasonal_forecast(df.withColumn("hour", F.col("idx") * 0.25), ["service"], "hour", "value", horizon=2)
    assert f.where("service IS NULL AND future").count() == 2


def test_sample_of_classes_is_bounded_and_never_empty(spark):
    from capstan.operators.models import bounded_rows, class_fractions

    n = {0: 599_999_000, 1: 1000}  # 600 million rows, a rare class
    take = {c: f * n[c] for c, f in class_fractions(n, 2000).items()}
    assert abs(sum(take.values()) - 2000) < 1 and take[1] >= 200
    assert class_fractions({0: 5, 1: 1}, 2000) == {0: 1.0, 1: 1.0} and class_fractions({}, 10) == {}
    d = spark.range(60_000).select(F.lit(1.0).alias("x"), F.when(F.col("id") % 100 == 0, 1).when(F.col("id") % 100 < 98, 0).alias("y"))  # equal rows
    got = {r["y"]: r["count"] for r in bounded_rows(d, 2000, "y").groupBy("y").count().collect()}
    assert set(got) == {0, 1} and 150 < got[1] < 290 and 1600 < got[0] < 1950


def test_a_null_value_is_not_clipped(spark):
    df = spark.createDataFrame([("a", float(k) if k % 5 else None) for k in range(40)] + [("a", 1e6), ("b", None)], "service string, value double")
    got = [r["value"] for r in fe.clip_outliers(df, ["value"], 1.0, ["service"]).collect()]
    assert len(got) == 42 and sum(v is None for v in got) == 9 and max(v for v in got if v is not None) < 100
