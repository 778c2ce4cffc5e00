"""Streams lose no row: closed windows, the late table and windows computed again."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from capstan.streaming import late
from capstan.streaming import streams as ss

SCHEMA = "service string, metric string, ts timestamp, value double"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def feed(spark, batches):
    """One file a micro-batch; each row is a minute after T0 (None: no time)."""
    d = tempfile.mkdtemp(prefix="capstan-feed-")
    for b, rows in enumerate(batches):
        data = [("s", "cpu_cores", None if m is None else T0 + dt.timedelta(minutes=m), v) for m, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(os.path.join(d, f"b={b:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    return stream, spark.read.schema(SCHEMA).parquet(d + "/*")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_more_micro_batches_than_progress_reports(spark):
    """Late rows among the first micro-batches, and more of these than Spark keeps reports of."""
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        minutes = [60, 1, 2, *range(61, 69)]
        stream, table = feed(spark, [[(m, 1.0)] for m in minutes])
        out = ss.run_windows(ss.stream_profile, stream, table, "many", "30 seconds")
        assert out.agg(F.sum("n")).first()[0] == len(minutes) and rows(out) == rows(ss.stream_profile(table))
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


@pytest.mark.parametrize("span,every", [("10 minutes", None), ("5 minutes", "2 minutes")])
def test_late_rows_go_to_their_table_and_back(spark, span, every):
    batches = [[(0, 1.0), (3, 2.0)], [(40, 3.0), (1, 4.0)], [(41, 5.0), (2, 6.0), (None, 9.0), (29, 7.0)], [], [(30, 8.0), (90, 1.0)], [(89, 2.0), (39.5, 3.0)]]
    stream, table = feed(spark, batches)

    def profile(samples):
        w = F.window("ts", span, every)
        return samples.groupBy("service", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
            "service", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")

    windows = late.Windows.of(spark, span, "10 minutes", every)
    root = late.run_windows_with_late(profile, stream, windows)
    side = [(r["value"], r["batch"], r["missed"]) for r in late.late_rows(root, stream).orderBy("batch", "value").collect()]
    # the watermark is 10 minutes before the newest row of the earlier micro-batches
    at = {b: T0 + dt.timedelta(minutes=m) for b, m in ((2, 30), (4, 31), (5, 80))}
    assert [x for x in side if x[0] in (6.0, 3.0)] == [(6.0, 2, at[2]), (3.0, 5, at[5])]
    whole = profile(table.where("ts IS NOT NULL"))
    alone = rows(late.closed_windows(root, profile, table, windows))
    assert alone != rows(whole)
    assert rows(late.complete(root, profile, stream, table, windows)) == rows(whole)


def test_only_windows_of_late_rows_are_computed_again(spark):
    stream, table = feed(spark, [[(0, 1.0), (1, 1.0), (2, 1.0)], [(100, 1.0)], [(1, 5.0)]])
    windows = late.Windows.of(spark, "1 minute", "10 minutes")
    root = late.run_windows_with_late(ss_profile, stream, windows)
    marked = table.withColumn("value", F.when(F.col("ts") == F.lit(T0), F.raise_error(F.lit("read again")).cast("double")).otherwise(F.col("value")))
    got = {r["window_start"]: r["total"] for r in late.complete(root, ss_profile, stream, marked, windows).collect()}
    assert got[T0] == 1.0 and got[T0 + dt.timedelta(minutes=1)] == 6.0


def ss_profile(samples):
    return ss.stream_profile(samples, "1 minute")


def test_restart_and_empty_stream(spark):
    base = tempfile.mkdtemp(prefix="capstan-base-")
    d = tempfile.mkdtemp(prefix="capstan-land-")
    windows = late.Windows.of(spark, "1 minute", "10 minutes")
    stream = spark.readStream.schema(SCHEMA).parquet(d + "/*")
    for k, minutes in enumerate(([0, 1, 50], [2, 51, 70], [])):
        if minutes:
            spark.createDataFrame([("s", "m", T0 + dt.timedelta(minutes=m), float(m)) for m in minutes], SCHEMA).write.parquet(f"{d}/{k}")
        late.run_windows_with_late(ss_profile, stream, windows, base=base)
    table = spark.read.schema(SCHEMA).parquet(d + "/*")
    assert [(r["value"], r["batch"]) for r in late.late_rows(base, stream).collect()] == [(2.0, 1)]
    assert rows(late.complete(base, ss_profile, stream, table, windows)) == rows(ss_profile(table))
    stream, table = feed(spark, [[]])
    assert ss.run_windows(ss_profile, stream, table, "none", "1 minute").count() == 0
