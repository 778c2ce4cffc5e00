"""Chunked trailing windows (with halo) equal the plain whole-series windows."""

from pyspark.sql import functions as F

from capstan.operators import derive as dv
from capstan.operators import features as fe
from capstan.operators import strategy as st
from capstan.sources import adapters as ad

SF = "/root/testdata/sf0.001"


def _rows(df, key, cols):
    return {r[key]: tuple(None if r[c] is None else (round(r[c], 9) if isinstance(r[c], float) else r[c])
                          for c in cols) for r in df.collect()}


def test_lag_rolling_sequences_chunked_equal_plain(spark):
    e = ad.gappy(spark, SF)
    for chunk in (14, 22):
        a = fe.rolling(fe.lag_features(e, ["cpu_cores_value"], chunk_rows=chunk), ["cpu_cores_value"],
                       chunk_rows=chunk)
        b = fe.rolling(fe.lag_features(e, ["cpu_cores_value"], chunk_rows=None), ["cpu_cores_value"],
                       chunk_rows=None)
        cols = [c for c in a.columns if "_lag" in c or "_roll" in c]
        assert a.count() == e.count()
        assert _rows(a, "event_id", cols) == _rows(b, "event_id", cols)
    s1 = fe.sequences(e, ["cpu_cores_value"], "cpu_cores_value", 5, chunk_rows=6)
    s2 = fe.sequences(e, ["cpu_cores_value"], "cpu_cores_value", 5, chunk_rows=None)
    k = lambda r: (r["experiment_id"], r["idx"])
    assert {k(r): r["sequence"] for r in s1.collect()} == {k(r): r["sequence"] for r in s2.collect()}
    d1 = dv.network_activity(dv.service_stability(e, chunk_rows=5), chunk_rows=5)
    d2 = dv.network_activity(dv.service_stability(e, chunk_rows=None), chunk_rows=None)
    cols = ["network_activity_rate_value", "service_stability_value"]
    assert _rows(d1, "event_id", cols) == _rows(d2, "event_id", cols)


def test_stability_chunked_equals_plain(spark):
    s = ad.strategy_samples(spark, SF)
    a = st.stability_features(s, chunk_rows=12)
    b = st.stability_features(s, chunk_rows=None)
    cols = ["volatility", "scaling_event"]
    assert a.count() == s.count()
    assert _rows(a, "seq", cols) == _rows(b, "seq", cols)


def test_fill_gaps_chunked_equals_plain(spark):
    g = ad.gappy(spark, SF).select("event_id", "experiment_id", "idx", "cpu_cores_value")
    # long gaps: blank out whole runs so carries must cross several chunks
    g = g.withColumn("cpu_cores_value", F.when((F.col("idx") % 17) < 9, None).otherwise(F.col("cpu_cores_value")))
    a = dv.fill_gaps(g, ["cpu_cores_value"], chunk_rows=3)
    b = dv.fill_gaps(g, ["cpu_cores_value"], chunk_rows=None)
    assert _rows(a, "event_id", ["cpu_cores_value"]) == _rows(b, "event_id", ["cpu_cores_value"])
    assert a.where(F.col("cpu_cores_value").isNull()).count() == 0


def test_future_target_chunked_equals_plain(spark):
    from capstan.operators import targets as tg
    e = ad.experiments(spark, SF)
    a = tg.future_change_target(e, chunk_rows=5)
    b = tg.future_change_target(e, chunk_rows=None)
    cols = ["rel_change", "y_class", "y_reg"]
    assert a.count() == b.count()
    assert _rows(a, "event_id", cols) == _rows(b, "event_id", cols)


def test_sequences_keep_columns_without_a_join(spark):
    e = ad.experiments(spark, SF)
    s = fe.sequences(e, ["cpu_cores_value"], "cpu_cores_value", 5, chunk_rows=6, extra=("service", "event_id"))
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {(r["experiment_id"], r["idx"]): (r["service"], r["event_id"]) for r in e.where("idx >= 5").collect()}
    assert {(r["experiment_id"], r["idx"]): (r["service"], r["event_id"]) for r in s.collect()} == want
