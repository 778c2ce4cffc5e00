"""First and second moments of many columns in one pass.

Each task adds up its Arrow batches as matrix products and gives out one row a pair
of columns; the sums over tasks are the moments.  Values are shifted by the column
means first, so that nothing is lost to cancellation.  Nulls count pairwise: a pair
has the rows in which both values are present.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Column means, and per pair (i, j) over their shared rows: number of rows, sum and
    squares of column i, products, shifted by the means.  Matrices as wide as the list
    of columns."""
    d = len(columns)
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_m{k}") for k, c in enumerate(columns)])
    means = np.array([x or 0.0 for x in data.agg(*[F.avg(f"_m{k}") for k in range(d)]).first()])

    def add_up(batches):
        n, s, q, p = np.zeros((4, d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - means
            held = ~np.isnan(x)
            x[~held] = 0.0
            seen = held.astype(float)
            n += seen.T @ seen
            s += x.T @ seen
            q += (x * x).T @ seen
            p += x.T @ x
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(at // d), pa.array(at % d), pa.array(n.ravel()), pa.array(s.ravel()), pa.array(q.ravel()), pa.array(p.ravel())],
                                         ["i", "j", "n", "s", "q", "p"])

    parts = data.mapInArrow(add_up, "i long, j long, n double, s double, q double, p double")
    sums = np.zeros((4, d, d))
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nsqp"]).collect():  # one row a pair of columns
        sums[:, r["i"], r["j"]] = [r[c] for c in "nsqp"]
    return (means, *sums)


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariances of pairwise complete rows (NaN where fewer than two)."""
    _, n, s, _, p = moments(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (p - s * s.T / n) / np.where(n > 1, n - 1, np.nan)


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of pairwise complete rows; 0 where a column is constant."""
    _, n, s, q, p = moments(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        v = q - s * s / n
        r = (p - s * s.T / n) / np.sqrt(v * v.T)
    return np.nan_to_num(np.clip(r, -1.0, 1.0), posinf=0.0, neginf=0.0)
