"""Rightsizing: profiles, recommendations and validation (reference test values)."""

import numpy as np
from pyspark.sql import functions as F

from capstan.operators import rightsize as rz


def _samples(spark, rows):
    return spark.createDataFrame(rows, "service string, metric string, value double")


def test_cpu_profile_matches_pandas_quantile(spark):
    rng = np.random.default_rng(0)
    vals = rng.uniform(0.1, 0.8, 100)
    df = _samples(spark, [("s", "cpu_cores", float(v)) for v in vals])
    p = rz.usage_profile_cpu(df).first()
    assert abs(p["percentile_value"] - float(np.quantile(vals, 0.95))) < 1e-12
    assert abs(p["median"] - float(np.median(vals))) < 1e-12
    assert abs(p["std"] - float(np.std(vals, ddof=1))) < 1e-12
    assert p["count"] == 100


def test_recommendations_with_and_without_data(spark):
    inv = spark.createDataFrame([("a", "default", "c1", "100m", "128Mi"), ("b", "default", "c2", "5m", "256Mi")],
                                "service string, namespace string, container string, "
                                "cpu_request string, memory_request string")
    s = _samples(spark, [("a", "cpu_cores", 0.1), ("a", "cpu_cores", 0.2), ("a", "cpu_cores", 0.3),
                         ("a", "mem_bytes", 100.0 * 1024 ** 2), ("a", "mem_bytes", 150.0 * 1024 ** 2)])
    r = {x["service"]: x for x in rz.recommendations(inv, s).collect()}
    # p95 of (0.1, 0.2, 0.3) = 0.29 -> 290m; memory 150Mi * 1.15 = 172.5Mi -> half-up 173Mi
    assert r["a"]["recommended_cpu"] == "290m"
    assert r["a"]["recommended_memory"] == "173Mi"
    assert r["a"]["cpu_has_data"] and r["a"]["mem_has_data"]
    # no samples: 0.1 cores and 128 Mi
    assert r["b"]["recommended_cpu"] == "100m" and r["b"]["recommended_memory"] == "128Mi"
    assert not r["b"]["cpu_has_data"]


def test_low_cpu_warning(spark):
    recs = spark.createDataFrame([("s", "c", "5m", "256Mi")],
                                 "service string, container string, recommended_cpu string, recommended_memory string")
    v = rz.validate_recommendations(recs).first()
    assert len(v["warnings"]) == 1 and "low CPU" in v["warnings"][0]
    assert v["cpu_flag"] == "low_cpu" and v["memory_flag"] is None


def test_approx_mode_close_to_exact(spark):
    df = spark.range(5000).select(F.lit("s").alias("service"), (F.col("id") / 5000.0).alias("value"))
    ex = rz.usage_profile_cpu(df).first()["percentile_value"]
    ap = rz.usage_profile_cpu(df, mode="approx").first()["percentile_value"]
    assert abs(ex - ap) < 1e-3
