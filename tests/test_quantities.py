"""Exact values of the quantity parsers and formatters (reference unit tests)."""

from pyspark.sql import functions as F

from capstan.functions import quantities as q


def _one(spark, expr, value, ddl):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_parse_cpu(spark):
    cases = {"100m": 0.1, "500m": 0.5, "1": 1.0, "2.5": 2.5, "Unknown": 0.0, "": 0.0, None: 0.0,
             "250n": 250e-9, "abc": 0.0, "xm": 0.0}
    for text, want in cases.items():
        got = _one(spark, q.parse_cpu, text, "string")
        assert abs(got - want) < 1e-12, (text, got)


def test_parse_memory(spark):
    cases = {"1024Ki": 1024 * 1024, "128Mi": 128 * 1024 ** 2, "1Gi": 1024 ** 3, "512K": 512000,
             "1.5M": 1500000, "2G": 2 * 10 ** 9, "12345": 12345, "Unknown": 0, "": 0, None: 0, "bad": 0}
    for text, want in cases.items():
        assert _one(spark, q.parse_memory, text, "string") == want, text


def test_format_cpu(spark):
    cases = {0.1: "100m", 0.5: "500m", 1.0: "1", 2.5: "2.5", 0.0999: "99m", 1.2345678: "1.235", 10.0: "10"}
    for v, want in cases.items():
        assert _one(spark, q.format_cpu, v, "double") == want, v


def test_format_memory(spark):
    assert _one(spark, q.format_memory, float(1024 ** 3), "double") == "1.0Gi"
    assert _one(spark, q.format_memory, float(128 * 1024 ** 2), "double") == "128Mi"
    assert _one(spark, q.format_memory, 1024.0, "double") == "1Ki"
    assert _one(spark, q.format_memory, 1000.0, "double") == "1000"
    assert _one(spark, q.format_memory, 1.5 * 1024 ** 3, "double") == "1.5Gi"
