"""Window helpers that keep ordered windows bounded for very long series.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one
task; one series may hold a third of all rows.  Running sums and carried values
are computed in parts of bounded size with a small table of part totals; frames
that look back a bounded number of rows run per position chunk with a halo of the
rows just before it.  The answers are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, scratch_table

US = 1_000_000


def epoch_us(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


# Default rows per chunk for chunked trailing windows: large enough that the
# halo copies are a negligible share, small enough for one task's memory.
CHUNK_ROWS = 1_000_000


def is_long(df: DataFrame, keys, chunk_rows: int = CHUNK_ROWS) -> bool:
    """Whether some series has more than ``chunk_rows`` rows (counted)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    return not n.where(F.col("_n") > chunk_rows).isEmpty()


def sum_before(df: DataFrame, keys, order, value, out, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row in its
    series by ``order`` (0 for the first); both may be lists of as many names.

    Series of at most ``chunk_rows`` rows take a plain window.  As soon as one
    is longer, the table is dealt by range of (keys, order) into parts of about
    equal size, however the rows lie in time, and stored with its part; a row's
    sum is the total of the series' earlier parts plus the sum inside its part,
    so no task holds more than a part."""
    keys, order = list(keys), list(order)
    values, outs = ([value], [out]) if isinstance(out, str) else (list(value), list(out))
    back = (Window.unboundedPreceding, -1)
    zero = F.lit(0)
    if not is_long(df, keys, chunk_rows):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*back)
        return df.withColumns({o: F.coalesce(F.sum(v).over(w), zero) for v, o in zip(values, outs)})
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // chunk_rows))
    ranged = scratch_table(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    # one row for each part that a series lies in
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*back)
    offsets = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_part2"),
                            *[F.coalesce(F.sum(f"_t{i}").over(w), zero).alias(f"_off{i}") for i in range(len(values))])
    same = F.col("_part") == F.col("_part2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(*back)
    d = ranged.join(maybe_broadcast(offsets), same)
    return d.select(*df.columns, *[(F.col(f"_off{i}") + F.coalesce(F.sum(v).over(inside), zero)).alias(o) for i, (v, o) in enumerate(zip(values, outs))])


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join by equal keys, a null being equal to a null; the keys come once."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    right = right.select(*[F.col(k).alias(f"_same{i}") if k in keys else F.col(k)
                           for i, k in enumerate([*keys, *[c for c in right.columns if c not in keys]])])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_same{i}"))
    return left.join(right, same, how).drop(*[f"_same{i}" for i in range(len(keys))])


def dense_position(df: DataFrame, keys, order, pos: str = "_pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """0-based position of each row inside its series (by ``order``) without
    sending a long series to one task (see :func:`sum_before`)."""
    d = sum_before(df.withColumn("_one", F.lit(1)), keys, order, "_one", pos, chunk_rows).drop("_one")
    return d.withColumn(pos, F.col(pos).cast("long"))


def last_seen(df: DataFrame, keys, order, value: str, out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the series up to and with each
    row.  Long series are scanned by position chunks; the last value of every
    chunk is carried into the later ones by a table of one row a chunk."""
    keys = list(keys)
    upto = (Window.unboundedPreceding, 0)
    if not is_long(df, keys, chunk_rows):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    d = dense_position(df, keys, order, "_lpos", chunk_rows)
    d = scratch_table(d.withColumn("_lc", F.floor(F.col("_lpos") / chunk_rows)), "chunks")
    ends = d.where(F.col(value).isNotNull()).groupBy(*keys, "_lc").agg(F.max_by(value, "_lpos").alias("_end"))
    every = join_null_safe(d.select(*keys, "_lc").distinct(), ends, [*keys, "_lc"], "left")
    w = Window.partitionBy(*keys).orderBy("_lc").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*keys, "_lc", F.last("_end", ignorenulls=True).over(w).alias("_carry"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_lc").orderBy("_lpos").rowsBetween(*upto))
    d = join_null_safe(d.withColumn(out, here), maybe_broadcast(carry), [*keys, "_lc"])
    return d.withColumn(out, F.coalesce(out, "_carry")).drop("_lpos", "_lc", "_carry")


def by_chunks(df: DataFrame, keys, pos: str, halo_rows: int, fn, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Run a trailing-window operator per (series, position chunk).

    ``pos`` is a dense 0-based position inside each series.  The last
    ``halo_rows`` rows of every chunk are copied into the next chunk, so a
    frame looking back at most ``halo_rows`` rows sees exactly the rows it
    would see on the whole series; ``fn(frame_df, partition_keys)`` must
    partition its windows by ``partition_keys``.  Halo copies are dropped from
    the result.  ``chunk_rows=None`` runs ``fn`` on whole series.
    """
    keys = list(keys)
    if chunk_rows is None:
        return fn(df, keys)
    if halo_rows > chunk_rows:
        raise ValueError("halo must not exceed the chunk size")
    c = F.floor(F.col(pos) / chunk_rows)
    inner = F.col(pos) - c * chunk_rows
    copies = F.when(inner >= chunk_rows - halo_rows,
                    F.array(F.struct(c.alias("_chunk"), F.lit(False).alias("_halo")),
                            F.struct((c + 1).alias("_chunk"), F.lit(True).alias("_halo"))))\
        .otherwise(F.array(F.struct(c.alias("_chunk"), F.lit(False).alias("_halo"))))
    x = df.select("*", F.inline(copies))
    out = fn(x, [*keys, "_chunk"])
    return out.where(~F.col("_halo")).drop("_chunk", "_halo")


def chunked_pass(df: DataFrame, keys, pos: str, specs, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Run several trailing-window specs ``(halo_rows, fn)`` in ONE chunked
    pass: a single halo explode and a single exchange on (keys, chunk) that
    every window of every spec shares."""
    halo = max(h for h, _ in specs)

    def run(d, parts):
        for _, fn in specs:
            d = fn(d, parts)
        return d
    return by_chunks(df, keys, pos, halo, run, chunk_rows)


def prefix_counts(counts: DataFrame, keys, value: str, count: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For a table of (group, value, count) rows, add ``_below``: the total
    count of smaller values in the group."""
    return sum_before(counts, keys, [value], count, "_below", chunk_rows)


def by_chunks_both(df: DataFrame, keys, pos: str, halo_rows: int, fn, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Like :func:`by_chunks` for frames that look both ways (``rowsBetween(-h, h)``,
    ``lag``/``lead`` up to h): the first and last ``halo_rows`` rows of each
    chunk are copied into the previous and next chunk."""
    keys = list(keys)
    if halo_rows > chunk_rows:
        raise ValueError("halo must not exceed the chunk size")
    c = F.floor(F.col(pos) / chunk_rows)
    inner = F.col(pos) - c * chunk_rows
    own = F.struct(c.alias("_chunk"), F.lit(False).alias("_halo"))
    nxt = F.when(inner >= chunk_rows - halo_rows, F.struct((c + 1).alias("_chunk"), F.lit(True).alias("_halo")))
    prv = F.when(inner < halo_rows, F.struct((c - 1).alias("_chunk"), F.lit(True).alias("_halo")))
    copies = F.filter(F.array(own, nxt, prv), lambda s: s.isNotNull())
    x = df.select("*", F.inline(copies))
    out = fn(x, [*keys, "_chunk"])
    return out.where(~F.col("_halo")).drop("_chunk", "_halo")
