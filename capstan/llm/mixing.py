"""Mixing sources to target weights with hash-threshold histograms, in
DataFrame functions only.

Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is split again by the next hash bits, until the boundary lies
between two hash values.  Documents below the boundary are taken, found by a
comparison with their source's threshold; nothing is sorted.

Edge cases: a null text has size 0; the null source is a source of its own,
ordered last; rows equal in id and text share a hash and are taken together; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, is_small, sized, stored, text_of

#: Fixed by the contract: weights by source order, share of all sizes, most repeats.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2

#: 60 hash bits, refined by 15 bits at a time.
HASH_BITS = 60
LEVEL_BITS = 15


def size_of(col: Column) -> Column:
    """Words without ASCII white space in ``col`` (null: 0)."""
    return F.size(F.filter(F.split(col, SPACE), lambda w: w != "")).cast("long")


def hash_of(seed: str) -> Column:
    """60-bit seeded hash of the document (15 hex digits of an md5)."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_of().cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their 0-based position by code point, null last.

    The sources are dealt by range and stored with their part, so that positions
    are a part's offset plus the rank inside it; no task sees all sources."""
    key = F.struct(F.col("source").isNull(), F.col("source"))
    ranged = stored(sizes.repartitionByRange(8, key).withColumn("_part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # eight rows at most
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(F.broadcast(parts.select("_part", "_off")), "_part").select(
        "source", "source_size", (F.col("_off") + rank - 1).alias("position"))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words of each source: shares of the total by weight, stopped at
    ``max_epochs`` times the source's size, the excess shared again by weight
    among the others until none is above its stop.

    Each round sends three sums to the driver, whatever the number of sources."""
    w = F.lit(float(weights[-1]))
    for k, x in enumerate(weights[:-1]):
        w = F.when(F.col("position") % len(weights) == k, F.lit(float(x))).otherwise(w)
    src = stored(ordered_sources(sizes).withColumn("weight", w)
                 .withColumn("stop", (max_epochs * F.col("source_size")).cast("double")), "weights")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0) * total_share
    # the level is words per weight; sources whose share at it exceeds their stop are full
    level, full = 0.0, None
    while True:
        is_full = F.lit(False) if full is None else F.col("weight") * F.lit(full) > F.col("stop")
        got = src.agg(F.sum(F.when(is_full, F.col("stop")).otherwise(0.0)).alias("s"),
                      F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if not got["w"]:
            break
        level = (total - got["s"]) / got["w"]
        if full is not None and level <= full:
            break
        full = level
    share = F.col("weight") * F.lit(level)
    return src.select("source", "source_size", "weight",
                      F.when(share > F.col("stop"), F.col("stop")).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Per source: whole passes over it, and the hash below which documents are
    taken once more (``taken below``).

    ``rows`` has source, size and ``_h``; ``target`` one row per source."""
    todo = target.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("passes"))
    todo = todo.withColumn("passes", F.col("passes").cast("long")).withColumn(
        "budget", F.col("target") - F.col("passes") * F.col("source_size"))
    # low: first hash of the boundary bucket; below: words taken below it
    state = stored(todo.withColumn("low", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "state")
    # one row a source in every round: counted once
    near = F.broadcast if is_small(state) else (lambda df: df.hint("shuffle_hash"))
    shift = HASH_BITS
    while shift > 0:
        width, shift = shift, max(0, shift - LEVEL_BITS)
        side = near(state.select(F.col("source").alias("_s"), "low"))
        inside = rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).where(
            (F.col("_h") >= F.col("low")) & (F.col("_h") < F.col("low") + F.lit(1 << width)))
        hist = inside.groupBy("source", F.shiftright(F.col("_h"), shift).alias("b")).agg(F.sum("size").alias("words"))
        # at most 2^LEVEL_BITS rows of a source meet here
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        cum = hist.select(F.col("source").alias("_s"), "b", "words", (upto - F.col("words")).alias("before"), upto.alias("upto"))
        ends = cum.join(near(state.select(F.col("source").alias("_s2"), "budget", "below")),
                        F.col("_s").eqNullSafe(F.col("_s2"))).where(
            (F.col("below") + F.col("upto") > F.col("budget")))
        ends = ends.groupBy("_s").agg(F.min("b").alias("b"), F.min("before").alias("before"), F.min_by("words", "b").alias("last"))
        new = state.drop("last").join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        # a source without such a bucket is taken whole: its boundary lies past the last hash
        done = F.col("b").isNull()
        state = stored(new.select(
            "source", "source_size", "target", "passes", "budget",
            F.when(done, F.lit(1 << HASH_BITS)).otherwise(F.shiftleft(F.col("b"), shift)).alias("low"),
            F.when(done, F.col("below")).otherwise(F.col("below") + F.col("before")).alias("below"),
            F.coalesce(F.col("last"), F.lit(0).cast("long")).alias("last")), "state")
    # the boundary is one hash value; it is taken too if that comes nearer to the budget
    nearer = (F.col("below") + F.col("last") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("source", "source_size", "target", "passes",
                        (F.col("low") + F.when(nearer, F.lit(1)).otherwise(F.lit(0))).alias("cut"))


def mix(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every
    document (``copies`` times its size)."""
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_of()).alias("size"),
                              hash_of(seed).alias("_h")), "mix")
    cuts = stored(thresholds(rows, targets(_source_sizes(rows))), "cuts")
    return _with_copies(rows, cuts).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"))


def _with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    side = sized(cuts.withColumnRenamed("source", "_cx_s"))
    out = rows.join(side, F.col("source").cast("string").eqNullSafe(F.col("_cx_s"))).drop("_cx_s")
    return out.withColumn("copies", F.col("passes") + (F.col("_h") < F.col("cut")).cast("long"))


def mixed(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The documents of the mix with their own columns, repeated as often as the
    mix takes them.  Texts are not shuffled."""
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_of()).alias("size"),
                              hash_of(seed).alias("_h")), "mix")
    cuts = stored(thresholds(rows, targets(_source_sizes(rows))).select(
        F.col("source").alias("_cx_s"), F.col("passes").alias("_cx_p"), F.col("cut").alias("_cx_cut")), "cuts")
    out = docs.withColumn("_cx_h", hash_of(seed)).join(
        sized(cuts), F.col("source").cast("string").eqNullSafe(F.col("_cx_s")))
    n = (F.col("_cx_p") + (F.col("_cx_h") < F.col("_cx_cut")).cast("long")).cast("int")
    return out.withColumn("_cx_n", n).where(F.col("_cx_n") > 0).withColumn(
        "_cx_k", F.explode(F.sequence(F.lit(1), F.col("_cx_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
