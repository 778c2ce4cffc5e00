"""Checkpoint folder, scratch tables and counted broadcasts."""

from types import SimpleNamespace

import pytest

from capstan import session as se


def _session(master, conf=None):
    ctx = SimpleNamespace(master=master, setCheckpointDir=lambda d: None,
                          _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    return SimpleNamespace(sparkContext=ctx, conf=SimpleNamespace(get=lambda k, d=None: conf, set=lambda k, v: None))


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        se.checkpoint_dir(_session("spark://host:7077"))
    assert se.checkpoint_dir(_session("spark://host:7077", "hdfs:///ckpt")) == "hdfs:///ckpt"
    assert "capstan-ckpt-" in se.checkpoint_dir(_session("local[2]"))


def test_scratch_tables_are_dropped(spark):
    df = se.scratch_table(spark.range(10), "numbers")
    path = se._scratch[-1]
    assert df.count() == 10 and spark.read.parquet(path).count() == 10
    assert se.drop_scratch(spark) >= 1 and se._scratch == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_broadcast_follows_the_count_not_the_estimate(spark):
    big = spark.range(1000)
    plan = lambda d: big.join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(se.maybe_broadcast(spark.range(50), limit=50))
    assert "broadcast" not in plan(se.maybe_broadcast(spark.range(51), limit=50))
