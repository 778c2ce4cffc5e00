"""Windowed aggregates over a stream that lose no row.

Spark's own append mode drops a row whose window the watermark has passed.  Here
each micro-batch compares its rows with the watermark before anything is
aggregated (``foreachBatch``):

* rows of windows that are still open are kept in the ``open`` table (they are the
  state, and no more than the rows of a window's length and the allowed delay);
* windows that the new watermark passes are aggregated and go to ``closed``;
* rows behind the watermark go to ``late`` with the number of their micro-batch and
  the watermark that they missed.

The watermark is the greatest event time of the earlier micro-batches less the
delay, as Spark's is.  All folders are keyed by the micro-batch, so a retried one
overwrites its own output, and the watermark is written last.  When a finite run
ends, the windows still open are aggregated.  :func:`complete` puts the late rows
right: only the windows that they belong to are aggregated again, from the rows of
those windows in the batch table.

Edge cases: rows without a time belong to no window; with overlapping windows a
row may be late for some and in time for others, and counts in both places; an
empty stream gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, scratch_table, sized

#: Watermark before any row was seen.
NEVER = -(1 << 62)

Aggregate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Windows:
    """Windows of ``span`` that begin every ``every`` (both in microseconds, aligned
    to the epoch), and the allowed ``delay``; ``end`` and ``time`` are the columns
    that hold a window's end and a row's event time."""

    span: int
    every: int
    delay: int
    end: str = "window_end"
    time: str = "ts"

    @classmethod
    def of(cls, spark: SparkSession, span: str, delay: str, every: str | None = None, end: str = "window_end", time: str = "ts") -> Windows:
        """From interval texts such as ``5 minutes``."""
        us = [F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {x})") for x in (span, every or span, delay)]
        return cls(*spark.range(1).select(*us).first(), end, time)

    def at(self) -> Column:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    def last_end(self) -> Column:
        """End of the last window that a row belongs to."""
        return F.floor(self.at() / self.every) * self.every + self.span

    def first_end(self) -> Column:
        """End of the first window that a row belongs to."""
        return (F.floor((self.at() - self.span) / self.every) + 1) * self.every + self.span

    def ends(self) -> Column:
        """Microsecond end of an aggregated window."""
        return F.unix_micros(F.col(self.end).cast("timestamp"))


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_batch(spark: SparkSession, path: str, before: int) -> int | None:
    """Number of the last finished micro-batch below ``before`` in a table keyed by batch."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    ids = sorted((int(n.split("=")[1]) for n in names if n.startswith("batch=")), reverse=True)
    return next((i for i in ids if i < before and fs.exists(_folder(spark, f"{path}/batch={i}/_SUCCESS")[0])), None)


def _watermark(spark: SparkSession, root: str, batch: int | None) -> int:
    return NEVER if batch is None else spark.read.schema("mark long").parquet(f"{root}/mark/batch={batch}").first()["mark"]


def run_windows_with_late(aggregate: Aggregate, stream: DataFrame, windows: Windows, name: str = "windows", base: str | None = None) -> str:
    """Run a finite stream (``availableNow``) to its end; returns the folder of its
    tables.  With a fixed ``base`` a later run goes on where this one ended."""
    root = base.rstrip("/") if base else scratch_path(stream.sparkSession, f"stream-{name}")
    schema, last = stream.schema, {}

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        if last.get("batch", -1) >= k or "batch" not in last:  # the first batch of this run, or a retried one
            last["batch"] = _last_batch(spark, f"{root}/mark", k)
            last["mark"] = _watermark(spark, root, last["batch"])
        before, mark = last["batch"], last["mark"]
        is_late = windows.first_end() <= mark
        newest, n_late = batch.agg(F.max(windows.at()), F.count_if(is_late)).first()
        new_mark = mark if newest is None else max(mark, newest - windows.delay)
        if n_late:
            batch.where(is_late).withColumn("missed", F.timestamp_micros(F.lit(mark))).write.mode("overwrite").parquet(f"{root}/late/batch={k}")
        rows = batch.where(windows.last_end() > mark)
        if before is not None:
            rows = spark.read.schema(schema).parquet(f"{root}/open/batch={before}").unionByName(rows)
        if new_mark > mark:
            done = aggregate(rows).where((windows.ends() > mark) & (windows.ends() <= new_mark))
            done.write.mode("overwrite").parquet(f"{root}/closed/batch={k}")
        rows.where(windows.last_end() > new_mark).write.mode("overwrite").parquet(f"{root}/open/batch={k}")
        spark.range(1).select(F.lit(new_mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{root}/mark/batch={k}")
        last.update(batch=k, mark=new_mark)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", root + "/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return root


def _batches(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """All finished batches of a table, with their number; empty if there is none."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    p, fs = _folder(spark, f"{root}/{table}")
    if not fs.exists(p):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).parquet(f"{root}/{table}")


def late_rows(root: str, stream: DataFrame) -> DataFrame:
    """The rows behind the watermark, with ``missed`` (the watermark) and ``batch``."""
    return _batches(stream.sparkSession, root, "late", T.StructType([*stream.schema.fields, T.StructField("missed", T.TimestampType())]))


def closed_windows(root: str, aggregate: Aggregate, rows: DataFrame, windows: Windows) -> DataFrame:
    """The windows of a finished run without its late rows: those the watermark
    passed, and those still open at the end."""
    spark = rows.sparkSession
    out = _batches(spark, root, "closed", aggregate(rows).schema).drop("batch")
    end = _last_batch(spark, f"{root}/open", 1 << 62)
    if end is None:
        return out
    rest = aggregate(spark.read.schema(rows.schema).parquet(f"{root}/open/batch={end}"))
    return out.unionByName(rest.where(windows.ends() > _watermark(spark, root, end)))


def complete(root: str, aggregate: Aggregate, stream: DataFrame, table: DataFrame, windows: Windows) -> DataFrame:
    """The windows of a finished run with its late rows: windows that late rows
    belong to are aggregated again from their rows in ``table`` (the rows of the
    stream as a batch table); no other rows of it are used."""
    done = closed_windows(root, aggregate, table, windows)
    late = late_rows(root, stream)
    every = F.lit(windows.every)
    ends = late.select("missed", F.explode(F.sequence(windows.first_end(), windows.last_end(), every)).alias("_end"))
    ends = scratch_table(ends.where(F.col("_end") <= F.unix_micros("missed")).select("_end").distinct(), "late-windows")
    if ends.isEmpty():
        return done
    slot = F.floor(windows.at() / windows.every)
    slots = scratch_table(ends.select(F.explode(F.sequence(
        F.floor((F.col("_end") - windows.span) / windows.every), F.floor((F.col("_end") - 1) / windows.every))).alias("_slot")).distinct(), "late-slots")
    touched = table.join(sized(slots), slot == F.col("_slot"), "left_semi")
    ends = sized(ends)
    again = aggregate(touched).join(ends, windows.ends() == F.col("_end"), "left_semi")
    return done.join(ends, windows.ends() == F.col("_end"), "left_anti").unionByName(again)
