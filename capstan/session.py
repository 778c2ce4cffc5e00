"""Session helpers: building a session, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was computed and counted, and has at most
# this many rows.
BROADCAST_ROWS = 200_000


def get_session(master: str | None = None, app: str = "capstan",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with AQE on, UI off and UTC session time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # wide aggregates (normal equations, one-pass metric tables) stay in codegen
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.driver.memory", os.environ.get("CAPSTAN_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in
    ``spark.checkpoint.dir``.

    Only a local session (one machine: tests, benches) may leave it unset; it
    then gets a scratch folder.  On a cluster an unset folder is an error, because
    executors could not read what the driver's machine holds.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="capstan-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder, removed by
    :func:`drop_scratch`."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process.  Results that still read them
    must have been written or collected before.  Returns how many were deleted."""
    jvm, n = spark.sparkContext._jvm, 0
    while _scratch:
        p = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def drop_table(table: DataFrame) -> None:
    """Delete a table of :func:`scratch_table` that nothing reads any more."""
    names = {os.path.basename(os.path.dirname(f)) for f in table.inputFiles()}
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _scratch if os.path.basename(p) in names]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _scratch.remove(path)


def scratch_table(df: DataFrame, label: str = "table", file_rows: int = 0) -> DataFrame:
    """Write ``df`` to a scratch folder (never machine-local on a cluster) and
    read it again: cuts the lineage, and later reads see the same rows.  With
    ``file_rows`` a file holds at most as many rows."""
    path = scratch_path(df.sparkSession, label)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A parameter table (one row per group) for a join: it is computed once,
    stored and counted, and broadcast if it has at most ``limit`` rows.  A larger
    one is returned for a shuffle join.  Estimates play no part."""
    return sized(scratch_table(df, "parameters"), limit)


def sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, or a cheap view of one, with a broadcast hint if it was
    counted to have at most ``limit`` rows."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
