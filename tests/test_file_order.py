"""More files than a micro-batch takes, each spanning all of the time."""

import os
import tempfile

from capstan.operators import strategy as st
from capstan.streaming import streams as ss

SF = "/root/testdata/sf0.001"


def test_file_order_does_not_decide_what_is_late(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    d = os.path.join(tempfile.mkdtemp(prefix="capstan-order-"), "events.parquet")
    events.repartition(5).write.parquet(d)
    few = lambda: ss.table_stream(spark, d, max_files=1)
    table = ss.strategy_stream(events)
    rows = lambda x: sorted((r["experiment_id"], r["window_start"], r["n"], round(r["cpu_hours"], 9)) for r in x.collect())
    got = ss.run_windows(ss.stream_summary, ss.strategy_stream(few()), table, "sum", "1 DAY")
    assert rows(got) == rows(ss.stream_summary(table))
    key = lambda x: {r["seq"]: (round(r["volatility"], 9), r["scaling_event"]) for r in x.collect()}
    assert key(ss.run_stability(ss.strategy_stream(few()), table)) == key(st.stability_features(table))
