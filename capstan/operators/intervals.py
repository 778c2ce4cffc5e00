"""Join of points in time to the intervals [start, end) that hold them.

There is no equal column to join on, so time is cut into buckets: an interval goes to
the level whose buckets are at least as long as it is (a power of two), where it meets
two buckets at the most, and a point goes to its bucket of every level that occurs.
Intervals are copied at most twice and points once a level, however long an interval
is; the join itself is on (keys, level, bucket), which the shuffle deals out and skew
handling splits.

Where only the number and the sum of an interval's points are asked for (``value``), no
pair is made: they are differences of running sums along time, in buckets that an
interval meets two of at the most, so the work does not grow with the points of an interval.

Rows without a time, intervals without an end or of no length, match nothing; a null
key matches a null key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .windows import epoch_us, join_null_safe, maybe_broadcast, sum_before


def _level(length: Column) -> Column:
    """Least l with length <= 2 ** l."""
    return F.length(F.bin(F.greatest(length - 1, F.lit(0).cast("long")))).cast("int")


def _bucket(time: Column, level: Column) -> Column:
    return F.call_function("shiftright", time, level)


def interval_join(points: DataFrame, intervals: DataFrame, keys=(), time: str = "ts", start: str = "start", end: str = "end",
                  value: str | None = None) -> DataFrame:
    """One row a point and interval that holds it: the columns of the interval, then
    those of the point without ``keys``.  With ``value`` one row an interval that holds
    a point: its columns, ``n`` and ``total``, the number of its points and the sum of
    their values (null without a value)."""
    keys = list(keys)
    if value is not None:
        return _totals(points, intervals, keys, time, start, end, value)
    a, b = epoch_us(start), epoch_us(end)
    held = intervals.where(a < b).withColumn("_level", _level(b - a)).select(
        "*", F.explode(F.sequence(_bucket(a, F.col("_level")), _bucket(b - 1, F.col("_level")))).alias("_bucket"))
    held = scratch_table(held, "intervals")
    levels = [r[0] for r in held.select("_level").distinct().collect()]  # 64 at the most
    if not levels:
        held = held.limit(0)
    t = epoch_us(time)
    places = F.array(*[F.struct(F.lit(x).alias("_l"), _bucket(t, F.lit(x)).alias("_b")) for x in levels or [0]])
    names = {c: f"_point{i}" for i, c in enumerate(points.columns)}
    p = points.where(t.isNotNull()).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.inline(places))
    same = (F.col("_level") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    at = epoch_us(names[time])
    out = held.join(p, same).where((at >= a) & (at < b))
    return out.select(*intervals.columns, *[F.col(n).alias(c) for c, n in names.items() if c not in keys])


def _totals(points: DataFrame, intervals: DataFrame, keys, time, start, end, value) -> DataFrame:
    """Intervals with the number and the sum of their points.  Values that are no finite
    number are counted apart from the running sum."""
    a, b = epoch_us(start), epoch_us(end)
    held = scratch_table(intervals.where(a < b).withColumns({"_a": a, "_b": b}), "intervals")
    longest = held.agg(F.max(F.col("_b") - F.col("_a"))).first()[0]
    width = 1 << ((longest or 1) - 1).bit_length()
    v, inf = F.col(value).cast("double"), float("inf")
    odd = F.isnan(v) | (v == inf) | (v == -inf)
    zero = F.lit(0).cast("long")
    counts = {"n": F.lit(1).cast("long"), "held": v.isNotNull().cast("long"), "nan": F.coalesce(F.isnan(v).cast("long"), zero),
              "up": F.coalesce((v == inf).cast("long"), zero), "down": F.coalesce((v == -inf).cast("long"), zero),
              "sum": F.when(odd, 0.0).otherwise(F.coalesce(v, F.lit(0.0)))}
    t = epoch_us(time)
    p = points.where(t.isNotNull()).select(*keys, t.alias("_t"), *[c.alias(f"_{k}") for k, c in counts.items()], F.lit(False).alias("_mark"))
    marks = held.select(*keys, F.explode(F.array("_a", "_b")).alias("_t"), *[(F.lit(0.0) if k == "sum" else zero).alias(f"_{k}") for k in counts],
                        F.lit(True).alias("_mark"))
    u = p.unionByName(marks).groupBy(*keys, "_t").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in counts], F.max("_mark").alias("_mark"))
    u = scratch_table(u.withColumn("_bucket", F.expr(f"(_t - pmod(_t, {width}L)) div {width}L")), "instants")
    all_of = u.groupBy(*keys, "_bucket").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in counts])
    d = sum_before(u, [*keys, "_bucket"], ["_t"], [f"_{k}" for k in counts], [f"_to_{k}" for k in counts]).where("_mark")
    d = join_null_safe(d, maybe_broadcast(all_of), [*keys, "_bucket"])
    at = {side: d.select(*keys, F.col("_t").alias(x), F.struct("_bucket", *[f"_{m}_{k}" for m in ("to", "all") for k in counts]).alias(side))
          for side, x in (("_from", "_a"), ("_upto", "_b"))}
    got = join_null_safe(join_null_safe(held, at["_from"], [*keys, "_a"]), at["_upto"], [*keys, "_b"])
    near = F.col("_from._bucket") == F.col("_upto._bucket")
    of = {k: F.when(near, F.col(f"_upto._to_{k}") - F.col(f"_from._to_{k}"))
          .otherwise(F.col(f"_from._all_{k}") - F.col(f"_from._to_{k}") + F.col(f"_upto._to_{k}")) for k in counts}
    total = F.when(of["held"] == 0, F.lit(None)).when((of["nan"] > 0) | ((of["up"] > 0) & (of["down"] > 0)), float("nan")) \
        .when(of["up"] > 0, inf).when(of["down"] > 0, -inf).otherwise(of["sum"])
    return got.where(of["n"] > 0).select(*intervals.columns, of["n"].alias("n"), total.cast("double").alias("total"))
