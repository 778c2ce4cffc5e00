"""Bracketed exact quantiles equal Spark's exact percentile."""

from pyspark.sql import functions as F

from capstan.operators.quantiles import exact_quantile


def test_exact_quantile_matches_percentile_with_many_passes(spark):
    # a hot group (70 % of rows, heavy duplicates), a skewed group, a tiny group
    base = spark.range(20000)
    df = base.select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "skew").otherwise("small").alias("g"),
        F.when(F.col("id") % 10 < 7, F.floor(F.col("id") / 13) % 500)
         .when(F.col("id") % 10 < 9, F.exp((F.col("id") % 997) / 50.0))
         .otherwise(F.col("id") * 0.5).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("one", 3.0)], "g string, v double"))
    for q in (0.0, 0.5, 0.95, 1.0):
        want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect()}
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", q, max_bracket=40, bins=8).collect()}
        assert want.keys() == got.keys()
        for k in want:
            assert abs(want[k] - got[k]) <= 1e-9 * max(1.0, abs(want[k])), (q, k, want[k], got[k])


def test_bounded_feature_modes_equal_exact(spark):
    from capstan.operators import features as fe
    from capstan.sources import adapters as ad
    g = ad.gappy(spark, "/root/testdata/sf0.001").select("event_id", "experiment_id", "cpu_cores_value")

    def rows(df, c):
        return {r["event_id"]: None if r[c] is None else round(r[c], 12) for r in df.collect()}
    assert rows(fe.impute_median(g, ["cpu_cores_value"], mode="bounded"), "cpu_cores_value") == \
        rows(fe.impute_median(g, ["cpu_cores_value"]), "cpu_cores_value")
    assert rows(fe.clip_outliers(g, ["cpu_cores_value"], k=0.5, mode="bounded"), "cpu_cores_value") == \
        rows(fe.clip_outliers(g, ["cpu_cores_value"], k=0.5), "cpu_cores_value")


def test_prefix_counts_brute_force(spark):
    from capstan.operators.windows import prefix_counts
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 211).alias("v"),
                                  F.lit(1).alias("c"))
    counts = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {(r["g"], r["v"]): r["_below"] for r in prefix_counts(counts, ["g"], "v", "c", chunk_rows=20).collect()}
    rows = df.collect()
    for (g, v), below in got.items():
        assert below == sum(1 for r in rows if r["g"] == g and r["v"] < v)


def test_bounded_median_absolute_error(spark):
    from capstan.operators.scoring import regression_metrics
    from capstan.sources import adapters as ad
    p = ad.predictions(spark, "/root/testdata/sf0.001")
    a = {(r["service"], r["target"], r["model"]): r for r in regression_metrics(p).collect()}
    b = {(r["service"], r["target"], r["model"]): r for r in regression_metrics(p, median_mode="bounded").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k]["median_absolute_error"] - b[k]["median_absolute_error"]) < 1e-6
        assert a[k]["mse"] == b[k]["mse"]


def test_one_value_in_a_third_of_the_rows_and_all_quantiles_at_once(spark):
    from capstan.operators.quantiles import exact_quantiles
    df = spark.range(9000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.sin("id") * 100).alias("v"))
    qs = [0.0, 0.25, 0.5, 0.67, 0.95, 1.0]
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", qs).alias("p")).collect()}
    for limit in (50, 10**9):
        got = {r["g"]: [r[f"q{i}"] for i in range(len(qs))] for r in exact_quantiles(df, ["g"], "v", qs, max_bracket=limit, bins=8).collect()}
        assert all(abs(a - b) < 1e-9 for g in want for a, b in zip(want[g], got[g]))
