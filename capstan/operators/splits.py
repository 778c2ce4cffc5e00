"""Train / test splits and fold plans (P-1..P-4) from row positions.

``pos`` is the 0-based position inside the series (``idx`` of the
experiment tables) and ``n`` the series length (a group count joined back),
so no split collects a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .derive import KEYS

TEST_SHARE = 0.2
SEED = 42


def _with_n(df: DataFrame, keys) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(maybe_broadcast(n), list(keys))


def time_split(df: DataFrame, test: float = TEST_SHARE, keys=KEYS, pos: str = "idx") -> DataFrame:
    """P-1: the first ``int(n (1 - test))`` rows of each series are train."""
    d = _with_n(df, keys)
    cut = F.floor(F.col("_n") * (1 - test))
    return d.withColumn("split", F.when(F.col(pos) < cut, "train").otherwise("test")).drop("_n")


def random_split(df: DataFrame, id_col: str, test: float = TEST_SHARE, seed: int = SEED, keys=KEYS) -> DataFrame:
    """P-2: shuffled split: rows ordered by ``xxhash64(id, seed)``, the first
    ``int(n (1 - test))`` are train - independent of partitioning."""
    from .windows import dense_position
    d = _with_n(df, keys).withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    d = dense_position(d, keys, ["_h", id_col], "_r")
    cut = F.floor(F.col("_n") * (1 - test))
    return d.withColumn("split", F.when(F.col("_r") < cut, "train").otherwise("test")).drop("_n", "_h", "_r")


def expanding_folds(df: DataFrame, k: int, keys=KEYS, pos: str = "idx") -> DataFrame:
    """P-3: time-series folds i = 0..k-1: test = the i-th block of
    ``n div (k+1)`` rows counted from the end, train = every row before it.
    One output row per (row, fold) where the row takes part."""
    d = _with_n(df, keys)
    size = F.floor(F.col("_n") / (k + 1))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    x = d.select("*", F.explode(folds).alias("fold"))
    start = F.col("_n") - (F.lit(k) - F.col("fold")) * size
    role = F.when(F.col(pos) < start, "train").when(F.col(pos) < start + size, "test")
    return x.withColumn("role", role).where(F.col("role").isNotNull() & (size > 0)).drop("_n")


def contiguous_folds(df: DataFrame, k: int = 5, keys=KEYS, pos: str = "idx") -> DataFrame:
    """P-4: unshuffled k-fold: the first ``n % k`` folds hold one row more."""
    d = _with_n(df, keys)
    n, p = F.col("_n"), F.col(pos)
    base = F.floor(n / k)
    extra = n % k
    big = (base + 1) * extra
    fold = F.when(p < big, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - big) / base))
    return d.withColumn("fold", fold.cast("int")).drop("_n")
