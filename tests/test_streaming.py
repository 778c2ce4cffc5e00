"""Streams equal the batch operators on the same rows; late rows are dropped."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from capstan.operators import strategy as st
from capstan.sources import adapters as ad
from capstan.streaming import streams as ss

SF = "/root/testdata/sf0.001"


def test_stability_stream_equals_batch(spark):
    ev = ss.table_stream(spark, f"{SF}/events.parquet")
    path = ss.stream_stability(ss.strategy_stream(ev))
    got = {r["seq"]: (round(r["volatility"], 9), r["scaling_event"]) for r in spark.read.parquet(path).collect()}
    want = {r["seq"]: (round(r["volatility"], 9), r["scaling_event"])
            for r in st.stability_features(ad.strategy_samples(spark, SF)).collect()}
    assert got == want


def test_stability_stream_carries_state_across_batches(spark):
    d = tempfile.mkdtemp(prefix="capstan-src-")
    samples = ad.strategy_samples(spark, SF).select("experiment_id", "ts", "seq", "replica_count", "cpu_utilization")
    days = [r[0] for r in samples.select(F.to_date("ts")).distinct().orderBy(1).collect()][:6]
    for i, day in enumerate(days):   # one file per day, read one file per micro-batch
        samples.where(F.to_date("ts") == day).write.parquet(os.path.join(d, f"day={i}"))
    schema = samples.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/*")
              .withColumn("ts", F.col("ts").cast("timestamp")))
    path = ss.stream_stability(stream)
    got = {r["seq"]: round(r["volatility"], 9) for r in spark.read.parquet(path).collect()}
    batch = st.stability_features(samples.where(F.to_date("ts").isin(days)))
    want = {r["seq"]: round(r["volatility"], 9) for r in batch.collect()}
    assert got == want


def test_profile_drops_rows_behind_watermark(spark):
    d = tempfile.mkdtemp(prefix="capstan-late-")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = [("s", "cpu_cores", t0 + dt.timedelta(minutes=m), 1.0) for m in range(0, 60, 5)]
    spark.createDataFrame(first, "service string, metric string, ts timestamp, value double") \
        .write.parquet(os.path.join(d, "b=0"))
    late = [("s", "cpu_cores", t0 + dt.timedelta(minutes=1), 100.0)]          # 59 minutes late
    spark.createDataFrame(late, "service string, metric string, ts timestamp, value double") \
        .write.parquet(os.path.join(d, "b=1"))
    sch = "service string, metric string, ts timestamp, value double"
    stream = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    out = spark.read.parquet(ss.run_to_table(ss.stream_profile(stream, "1 minute", "10 minutes"), "late"))
    assert out.agg(F.max("max")).first()[0] == 1.0          # the late 100.0 never counted


def test_rightsize_stream_equals_batch_windows(spark):
    ev = ss.table_stream(spark, f"{SF}/events.parquet")
    table = ss.sample_stream(spark.read.parquet(f"{SF}/events.parquet"))
    got = ss.run_windows(ss.stream_rightsize, ss.sample_stream(ev), table, "rs", "5 MINUTES")
    batch = ss.stream_rightsize(table)
    rows = lambda d: {(r["service"], r["window_start"]): (r["p95"], r["recommended_cpu"], r["recommended_memory"])
                      for r in d.collect()}
    assert rows(got) == rows(batch) and got.count() == batch.count()


def test_windows_in_several_batches_are_complete(spark):
    d = tempfile.mkdtemp(prefix="capstan-parts-")
    events = spark.read.parquet(f"{SF}/events.parquet")
    days = [r[0] for r in events.select(F.to_date("ts")).distinct().orderBy(1).collect()]
    for i in range(0, len(days), 6):      # files in time order, one file a micro-batch
        events.where(F.to_date("ts").isin(days[i:i + 6])).coalesce(1).write.parquet(os.path.join(d, f"part={i:02d}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    got = ss.finalize_summary(ss.run_windows(ss.stream_summary, ss.strategy_stream(stream), ss.strategy_stream(events), "sum", "1 DAY"))
    want = ss.finalize_summary(ss.stream_summary(ss.strategy_stream(events)))
    rows = lambda d: sorted((r["experiment_id"], r["data_points"], round(r["total_cpu_hours"], 9)) for r in d.collect())
    assert rows(got) == rows(want)


def test_failed_run_is_raised(spark):
    import pytest

    ev = ss.sample_stream(ss.table_stream(spark, f"{SF}/events.parquet"))
    bad = ev.select("service", F.raise_error(F.lit("broken sample")).alias("x"))
    with pytest.raises(Exception, match="broken sample"):
        ss.run_to_table(bad, "bad")


def test_late_rows_are_counted(spark):
    d = tempfile.mkdtemp(prefix="capstan-late4-")
    sch = "experiment_id string, ts timestamp, seq long, replica_count int, cpu_utilization double"
    t0 = dt.datetime(2024, 1, 1)
    for b, minutes in enumerate(([0, 10, 20], [30, 5, 40])):
        spark.createDataFrame([("e", t0 + dt.timedelta(minutes=m), m, 1, float(m)) for m in minutes], sch).coalesce(1) \
            .write.parquet(os.path.join(d, f"b={b}"))
    stream = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    path = ss.stream_stability(stream)
    assert {r["seq"] for r in spark.read.parquet(path).collect()} == {0, 10, 20, 30, 40}
    late = spark.read.parquet(path[:-len("data")] + "late")
    assert late.agg(F.sum("late")).first()[0] == 1
