"""Two-pass external shuffle into shards.

Pass 1 scatters whole records by a seeded hash into buckets that fit in a
task's memory.  Pass 2 brings each bucket into an order that does not depend on
arrival, shuffles it with Fisher-Yates from a seed, and numbers its records
after those of the buckets before it.  Records go to shards in turn by that
number, so shard counts differ by one at most (law ``rows``).

Rows equal in every column share a hash.  Where their copies would fill more than
a part of a bucket, one row a hot group is kept with its count and the copies are
made anew, numbered, so that each number scatters to a bucket of its own choice.
That depends on the table's rows alone, so a lost executor changes nothing.

Edge cases: a null text has no bytes; null ids are scattered by the other columns;
equal rows are interchangeable; an empty table gives an empty result; columns
``shard`` and ``slot`` of the input are replaced; maps are compared by their sorted
entries.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, stored, text_of

BUCKET_BYTES = 64 << 20
#: Buckets at least, so that small inputs use several tasks too.
MIN_BUCKETS = 64
#: What a record takes besides its text.
ROW_BYTES = 64
#: Equal rows are hot from this part of a bucket's bytes on, or from this part of the
#: table's, so that the list of hot hashes has at most so many 8-byte entries.
HOT_PART, HOT_KEYS = 8, 1_000_000
#: Bytes and copies of one hot row that one task makes.
BLOCK_BYTES, BLOCK_COPIES = 64 << 20, 100_000


def fisher_yates(seed: int, bucket: int, n: int):
    """Seeded random order of ``n`` records (numpy's shuffle is Fisher-Yates)."""
    import numpy as np

    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def shuffled(docs: DataFrame, n_shards: int = 8, seed: int = 20, bucket_bytes: int = BUCKET_BYTES,
             min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """All records with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless
    from 0 in its shard)."""
    docs = docs.drop("shard", "slot")
    names = [f"`{c}`" for c in docs.columns]
    size = F.octet_length(text_of()).cast("long") + ROW_BYTES
    total = docs.agg(F.sum(size)).first()[0] or 0
    n_buckets = max(min_buckets, -(-total // bucket_bytes))
    keyed = docs.withColumn("_cx_h", F.xxhash64(F.lit(seed), *[comparable(f) for f in docs.schema.fields]))
    hot_bytes = max(min(bucket_bytes, max(total, 1) // n_buckets) // HOT_PART, total // HOT_KEYS)
    copies = keyed.groupBy("_cx_h").agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("bytes"))
    hot = stored(copies.where((F.col("n") > 1) & (F.col("n") * F.col("bytes") > hot_bytes)).select("_cx_h"), "hot-rows")
    rows = spread(keyed, hot, docs.columns, seed).withColumn("_cx_b", F.pmod(F.col("_cx_h"), F.lit(n_buckets)))

    schema = T.StructType([*docs.schema.fields, T.StructField("_cx_b", T.LongType()), T.StructField("_cx_k", T.LongType())])

    def pass_two(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_cx_h", "ascending"), ("doc_id", "ascending")])
        bucket = t.column("_cx_b")[0].as_py()
        t = t.take(pa.array(fisher_yates(seed, bucket, t.num_rows)))
        t = t.drop_columns(["_cx_h"])
        return t.append_column("_cx_k", pa.array(range(t.num_rows), pa.int64()))

    out = rows.repartition(int(min(n_buckets, 20_000)), "_cx_b").groupBy("_cx_b").applyInArrow(pass_two, schema)
    offsets = sized(stored(bucket_offsets(rows.select("_cx_b")), "buckets"))
    number = F.col("_cx_off") + F.col("_cx_k")
    return out.join(offsets, "_cx_b").select(
        *names, (number % n_shards).cast("int").alias("shard"), F.floor(number / n_shards).cast("long").alias("slot"))


def comparable(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c


def spread(keyed: DataFrame, hot: DataFrame, names: list[str], seed: int) -> DataFrame:
    """``keyed`` with a hash of its own for every copy of a hot row; other rows stay
    where they are.  ``hot`` has at most ``HOT_KEYS`` rows by its definition."""
    if hot.isEmpty():
        return keyed
    few, fields = F.broadcast(hot), [f for f in keyed.schema.fields if f.name in names]
    held = keyed.join(few, "_cx_h", "left_semi").groupBy("_cx_h", *[comparable(f).alias(f.name) for f in fields]).agg(F.count(F.lit(1)).alias("_cx_n"))
    step = F.greatest(F.lit(1), F.least(F.lit(BLOCK_COPIES), F.floor(BLOCK_BYTES / (F.octet_length(text_of()) + ROW_BYTES)))).cast("long")
    blocks = held.withColumn("_cx_d", step).withColumn("_cx_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_cx_n") - 1) / F.col("_cx_d")))))
    blocks = blocks.repartition("_cx_h", "_cx_s")
    first = F.col("_cx_s") * F.col("_cx_d")
    made = blocks.withColumn("_cx_c", F.explode(F.sequence(first, F.least(first + F.col("_cx_d"), F.col("_cx_n")) - 1)))
    back = [F.map_from_entries(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in fields]
    made = made.select(*back, F.xxhash64(F.lit(seed), "_cx_h", "_cx_c").alias("_cx_h"))
    return keyed.join(few, "_cx_h", "left_anti").select(*[F.col(f"`{c}`") for c in names], "_cx_h").unionByName(made)


def bucket_offsets(buckets: DataFrame, group: int = 1024) -> DataFrame:
    """Records in the buckets before each bucket, by sums in two levels, so that
    neither window holds more than a part of the buckets."""
    c = buckets.groupBy("_cx_b").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("_cx_b") / group))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("_cx_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = stored(c, "bucket-counts")
    groups = c.groupBy("g").agg(F.sum("n").alias("n"))
    outer = F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("g").alias("_g"), outer.alias("off"))  # one row for 1024 buckets
    return c.withColumn("_in", inner).join(groups, F.col("g") == F.col("_g")).select(
        "_cx_b", (F.col("off") + F.col("_in")).alias("_cx_off"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 20) -> None:
    """Shuffle and write: folders ``shard=0`` ..., files ordered by slot."""
    out = shuffled(docs, n_shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
