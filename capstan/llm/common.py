"""Shared helpers of the training-data operators.

Conventions used by all of them:

* only the named input columns are read, and internal columns start with
  ``_cx_``, so extra columns with any other name pass by or are ignored;
* a row is known by ``doc_id`` (null-safe) and a digest of its text, because
  ``doc_id`` may be null or repeated; rows equal in both get equal results;
* intermediate tables are written to the shared folder that the cluster names
  in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A side is broadcast only when it was counted and has at most this many
#: (narrow) rows; larger sides take a shuffle join.
BROADCAST_ROWS = 200_000

#: Words of the quality and mixing contracts: runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most ``limit`` rows (counted, not estimated)."""
    return df.limit(limit + 1).count() <= limit


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else with a
    hint to build the hash table of a shuffle join from it."""
    return F.broadcast(df) if is_small(df, limit) else df.hint("shuffle_hash")


def text_of(name: str = "text") -> Column:
    """Whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_digest(docs: DataFrame, *names: str) -> Column:
    """Digest of the named columns; with doc_id it tells rows apart."""
    return F.xxhash64(*[F.col(f"`{n}`") for n in names if n in docs.columns])


def fold_of(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def split_words(col: Column, pattern: str) -> Column:
    """Words of ``col`` in order, split by a separator pattern, without empty ones."""
    return F.filter(F.split(col, pattern), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row even where the
    body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def keep_rows(docs: DataFrame, rejected: DataFrame, *digest_of: str) -> DataFrame:
    """``docs`` without the rows named in ``rejected`` (``_cx_id``, ``_cx_rk``;
    a stored table).  The texts move only if the list is too long to broadcast."""
    left = docs.withColumn("_cx_rk", row_digest(docs, *digest_of))
    right = sized(rejected.select(F.col("_cx_id"), F.col("_cx_rk").alias("_cx_rk2")))
    cond = F.col("doc_id").eqNullSafe(F.col("_cx_id")) & (F.col("_cx_rk") == F.col("_cx_rk2"))
    return left.join(right, cond, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_portions(batches, column: str, most: int = 4 << 20):
    """The rows of Arrow batches in portions of at most ``most`` bytes in the named
    text or binary column, or of one longer row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < b.num_rows:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64 (Stafford's variant 13, as in SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept between documents of a task and emptied when
    it grows past ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
