"""Exact quantiles with bounded memory per group (linear interpolation, as
pandas' ``quantile`` and Spark's ``percentile``).

Spark's exact ``percentile`` keeps a value -> count map per group, so one hot
group with many distinct values lands whole in one task.  It is used where no group
has more than ``max_bracket`` rows (counted).  Otherwise every wanted rank
(``floor`` and ``ceil`` of ``q (n - 1)``) has a bracket of values of its own:

1. one aggregate gives n, min and max per group, the first bracket of each rank;
2. while a bracket holds more than ``max_bracket`` rows and more than one value,
   one aggregate over the rows inside such brackets counts an equi-width
   histogram with each bin's least and greatest value, and the bracket shrinks
   to the bin that holds the rank.  The ends of a bracket lie in different bins,
   so it shrinks in every pass, and passes go on until none is too wide;
3. the rows left in a bracket are grouped to (value, count) and the counts are
   summed up in order of value; ties, however many, are one row.

The (keys, value) projection is stored once, so the source is read twice however
many passes there are; only the bracket table (two rows per group and quantile) is
carried between passes, in the shared checkpoint folder.  A null key is a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, scratch_table, sized
from .windows import join_null_safe

MAX_BRACKET = 200_000
BINS = 1024


def exact_quantiles(df: DataFrame, keys, value: str, qs, prefix: str = "q",
                    max_bracket: int = MAX_BRACKET, bins: int = BINS) -> DataFrame:
    """(keys, ``<prefix>0``, ``<prefix>1``, ...) with the exact linear-interpolated
    quantiles ``qs`` of the non-null ``value`` per group."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    v = F.col("_v")
    size = scratch_table(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")), "sizes")
    if size.where(F.col("_n") > max_bracket).isEmpty():
        # no group is larger than a bracket may be: all its values fit a task
        q = d.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).alias("_qs"))
        return q.select(*keys, *[F.get("_qs", F.lit(i)).alias(f"{prefix}{i}") for i in range(len(qs))])
    d = scratch_table(d, "values")  # the narrow projection; the passes below read it instead of the source
    h = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    ranks = F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(side).alias("_side"), r.cast("long").alias("_r"), (x - F.floor(x)).alias("_f"))
                      for i, x in enumerate(h) for side, r in ((0, F.floor(x)), (1, F.ceil(x)))])
    st = size.select(*keys, F.explode(ranks).alias("_x"), "_n", "_lo", "_hi")
    st = scratch_table(st.select(*keys, "_x.*", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")), "brackets")
    bracket = ["_lo", "_hi", "_below"]

    def inside(chosen: DataFrame) -> DataFrame:
        b = sized(chosen.select(*keys, *bracket).distinct())
        return join_null_safe(d, b, keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))

    while True:
        wide = st.where((F.col("_in") > max_bracket) & (F.col("_hi") > F.col("_lo")))
        if wide.isEmpty():
            break
        bin_ = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
        hist = inside(wide).groupBy(*keys, *bracket, bin_.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min(v).alias("_bmin"), F.max(v).alias("_bmax"))
        w = Window.partitionBy(*keys, *bracket).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        t = F.col("_r") - F.col("_below")
        new = join_null_safe(wide, maybe_broadcast(hist), [*keys, *bracket]).where(
            (F.col("_before") <= t) & (t < F.col("_before") + F.col("_c"))).select(
            *keys, "_q", "_side", "_r", "_f", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
            (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_in"))
        narrow = st.where((F.col("_in") <= max_bracket) | (F.col("_hi") <= F.col("_lo")))
        st = scratch_table(narrow.unionByName(new), "brackets")

    settled = st.where(F.col("_lo") == F.col("_hi")).select(*keys, "_q", "_side", "_f", F.col("_lo").alias("_val"))
    left = st.where(F.col("_lo") < F.col("_hi"))
    counts = inside(left).groupBy(*keys, *bracket, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, *bracket).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # at most `max_bracket` rows
    counts = counts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    ranked = join_null_safe(counts, sized(left), [*keys, *bracket]).where(
        (F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_c"))).select(
        *keys, "_q", "_side", "_f", F.col("_v").alias("_val"))
    aggs = []
    for i in range(len(qs)):
        a, b = (F.max(F.when((F.col("_q") == i) & (F.col("_side") == side), F.col("_val"))) for side in (0, 1))
        f = F.max(F.when(F.col("_q") == i, F.col("_f")))
        aggs.append((a + f * (b - a)).alias(f"{prefix}{i}"))
    return settled.unionByName(ranked).groupBy(*keys).agg(*aggs)


def exact_quantile(df: DataFrame, keys, value: str, q: float, out: str = "quantile",
                   max_bracket: int = MAX_BRACKET, bins: int = BINS) -> DataFrame:
    """(keys, ``out``): one quantile of :func:`exact_quantiles`."""
    return exact_quantiles(df, keys, value, [q], "_q", max_bracket, bins).withColumnRenamed("_q0", out)


def quantile_table(df: DataFrame, keys, col: str, qs, mode: str = "exact", prefix: str | None = None) -> DataFrame:
    """Per-group quantiles of ``col`` as columns ``<prefix><i>`` (i = index in
    ``qs``): ``exact`` (bounded memory) or ``approx`` (``percentile_approx``)."""
    keys = list(keys)
    prefix = prefix or f"_q_{col}_"
    if mode in ("exact", "bounded"):
        return exact_quantiles(df, keys, col, qs, prefix)
    if mode != "approx":
        raise ValueError(mode)
    t = df.groupBy(*keys).agg(F.percentile_approx(col, list(qs), 10000).alias("_qs"))
    return t.select(*keys, *[F.col("_qs")[i].alias(f"{prefix}{i}") for i in range(len(qs))])
