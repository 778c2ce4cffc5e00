"""Metric series: counter resets, staleness, histogram edges, halo windows."""

import datetime as dt

from pyspark.sql import functions as F

from capstan.operators import series as se
from capstan.operators.windows import dense_position


def _counter(spark, points, service="s"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(service, t0 + dt.timedelta(seconds=s), i, float(v)) for i, (s, v) in enumerate(points)]
    return spark.createDataFrame(rows, "service string, ts timestamp, seq long, value double")


def test_rate_handles_reset_and_single_sample(spark):
    # 0 -> 10 -> 20 -> reset to 5 -> 15, every 10 s; range 60 s covers all
    df = _counter(spark, [(0, 0), (10, 10), (20, 20), (30, 5), (40, 15)])
    r = {x["seq"]: x["rate"] for x in se.rate(df, 60).collect()}
    assert 0 not in r                            # one sample in its window: no output
    assert abs(r[4] - (10 + 10 + 5 + 10) / 60) < 1e-12


def test_rate_in_parts_equals_plain_window(spark):
    # resets, ties in time, two series, ranges that span many parts
    df = _counter(spark, [(s * 7 // 3, (s * 13) % 50 + s) for s in range(300)]).unionByName(
        _counter(spark, [(s * 50, s) for s in range(40)], "t"))
    for range_s in (20, 120, 5000):
        small = {(x["service"], x["seq"]): x["rate"] for x in se.rate(df, range_s, chunk_rows=16).collect()}
        plain = {(x["service"], x["seq"]): x["rate"] for x in se.rate(df, range_s).collect()}
        assert small.keys() == plain.keys()
        assert all(abs(small[k] - plain[k]) < 1e-9 for k in plain)


def test_range_eval_in_parts_equals_plain_and_bounds_reach_the_scan(spark, tmp_path):
    _counter(spark, [(s * 11, s) for s in range(200)]).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    args = ("2024-01-01 00:05:00", "2024-01-01 00:20:00", 30, 40)
    rows = lambda d: sorted((x["ts"], x["value"]) for x in d.collect())
    plain = se.range_eval(df, *args)
    assert rows(plain) == rows(se.range_eval(df, *args, chunk_rows=16))
    plan = plain._jdf.queryExecution().explainString(plain.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(ts" in plan and "LessThanOrEqual(ts" in plan


def test_one_busy_series_is_dealt_to_many_parts(spark):
    from capstan.operators import windows as wd

    # three quarters of the rows: one series within one hour
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                  F.timestamp_millis(F.col("id")).alias("ts"), F.col("id").alias("seq"))
    got = wd.dense_position(df, ["k"], ["ts", "seq"], chunk_rows=100)
    hot = got.where("k = 'hot'").orderBy("seq").collect()
    assert [r["_pos"] for r in hot] == list(range(3000))
    parts = spark.read.parquet([p for p in __import__("capstan.session", fromlist=["x"])._scratch if "/ranged-" in p][-1])
    assert parts.where("k = 'hot'").select("_part").distinct().count() >= 20


def test_range_eval_staleness(spark):
    df = _counter(spark, [(0, 1), (30, 2), (400, 3)])
    out = se.range_eval(df, "2024-01-01 00:00:00", "2024-01-01 00:10:00", 60, lookback_s=300)
    got = {x["ts"].minute: x["value"] for x in out.collect()}
    assert got[0] == 1 and got[1] == 2 and got[5] == 2
    assert 6 not in got                           # last sample at 0:30 is stale after 5:30
    assert got[7] == 3


def test_histogram_quantile_edges(spark):
    inf = float("inf")
    rows = [("a", 1, 0.1, 5), ("a", 1, 0.5, 10), ("a", 1, inf, 10),      # interpolate in 0.1..0.5
            ("b", 1, 0.1, 0), ("b", 1, 0.5, 0), ("b", 1, inf, 4),        # rank in +Inf -> 0.5
            ("c", 1, 0.1, 0), ("c", 1, 0.5, 0), ("c", 1, inf, 0)]        # empty -> NULL
    b = spark.createDataFrame(rows, "service string, ts long, le double, cumulative long")
    q = {x["service"]: x["quantile"] for x in se.histogram_quantile(b, 0.75).collect()}
    assert abs(q["a"] - (0.1 + 0.4 * (7.5 - 5) / 5)) < 1e-12
    assert q["b"] == 0.5
    assert q["c"] is None


def test_dense_position_matches_row_number(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"),
                                  F.timestamp_seconds(F.col("id") * 977).alias("ts"), F.col("id").alias("seq"))
    pos = {(x["k"], x["seq"]): x["_pos"] for x in dense_position(df, ["k"], ["ts", "seq"]).collect()}
    from pyspark.sql import Window
    rn = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("ts", "seq")) - 1)
    assert all(pos[(x["k"], x["seq"])] == x["rn"] for x in rn.collect())


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_rate_equals_brute_force_without_frames_that_slide(spark):
    import random

    r = random.Random(5)
    rows = [(k, r.choice([r.randrange(0, 90), r.randrange(400, 460), 900]), i, r.choice([None, *map(float, range(9))])) for i in range(160) for k in ("a", None)]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, t0 + dt.timedelta(seconds=s), i, v) for k, s, i, v in rows], "service string, ts timestamp, seq long, value double")
    for range_s in (1, 7, 60, 1000):
        want = {}
        for key in ("a", None):
            s = sorted((x[1], x[2], x[3]) for x in rows if x[0] == key)
            inc = [None if i == 0 or s[i - 1][2] is None or s[i][2] is None else s[i][2] - (s[i - 1][2] if s[i][2] >= s[i - 1][2] else 0) for i in range(len(s))]
            for t, seq, _ in s:
                held = [inc[i] for i in range(len(s)) if t - range_s < s[i][0] <= t]
                known = [x for x in held if x is not None]
                if len(held) >= 2:
                    want[key, seq] = (sum(known) - (held[0] or 0)) / range_s if known else None
        out = se.rate(df, range_s)
        got = {(x["service"], x["seq"]): x["rate"] for x in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
        # a frame that slides sums all rows of a range again at each row
        assert "RangeFrame, -" not in _plan(out)


def test_grid_rates_read_the_latest_of_equal_times(spark):
    df = _counter(spark, [(0, 1), (60, 5), (60, 9), (60, 7)])
    for seed in range(3):
        got = se.range_eval(df.orderBy(F.xxhash64("seq", F.lit(seed))), "2024-01-01 00:00:00", "2024-01-01 00:02:00", 60, 90).collect()
        assert sorted((x["ts"].minute, x["value"]) for x in got) == [(0, 1.0), (1, 7.0), (2, 7.0)]


def test_requests_per_second_rates_all_sources_at_once(spark):
    rows = [(m, s, c, t, i, v) for m, s in (("mesh", "a"), ("own", "a"), ("own", "b")) for c in ("200", "500") for i, (t, v) in enumerate([(0, 0.0), (60, 60.0), (120, 180.0)])]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(m, s, c, t0 + dt.timedelta(seconds=t), i, v) for m, s, c, t, i, v in rows],
                               "metric string, service string, status string, ts timestamp, seq long, value double")
    out = se.requests_per_second(df, "2024-01-01 00:02:00", "2024-01-01 00:02:00", 60, 100, ["edge", "mesh", "own"])
    assert sorted((x["service"], x["priority"], x["requests_per_second"]) for x in out.collect()) == [("a", 1, 1.2), ("b", 2, 1.2)]
