"""Iterative imputation: every column is regressed on the others, round after round.

Missing values start as column means.  In each round every column has a least-squares
fit on all other columns, over the rows that hold it, with the fills of the round
before; then all missing values are predicted anew.  The fits of a round need one pass:
each task adds up one matrix a column (products over the rows that hold the column), and
the sums over tasks are the normal equations, as wide as the list of columns whatever
the number of rows.  A row's fills are the same fits applied in turn, so nothing is
stored between rounds but the fits.

Null and NaN are missing.  A column without a value stays missing and takes no part; a
row without any value gets the fits at the column means; of collinear columns the
shortest coefficients are taken; an empty table comes back empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_table

ROUNDS = 10
#: Directions of the normal equations below this share of the largest are left out.
SINGULAR = 1e-10


@dataclass(frozen=True)
class Imputer:
    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    fits: list[np.ndarray]  # a round: a row a column, the constant first

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the missing values of the columns filled, as doubles."""
        if not self.columns:
            return df
        wanted = [f.name in self.columns for f in df.schema.fields]
        schema = T.StructType([T.StructField(f.name, T.DoubleType(), True) if w else f for w, f in zip(wanted, df.schema.fields)])
        at = [df.columns.index(c) for c in self.columns]
        # by position, since names may hold dots
        own = [F.col(f"`{c}`") for c in df.columns]
        cast = df.select(*[(c.cast("double") if w else c).alias(f"_i{k}") for k, (w, c) in enumerate(zip(wanted, own))])

        def run(batches):
            for b in batches:
                z, held = standardized([b.column(k) for k in at], self.means, self.scales)
                values = replay(z, held, self.fits) * self.scales + self.means
                arrays = list(b.columns)
                for j, k in enumerate(at):
                    own = b.column(k).to_numpy(zero_copy_only=False).astype(float)
                    arrays[k] = pa.array(np.where(held[:, j], own, values[:, j]), pa.float64())
                yield pa.RecordBatch.from_arrays(arrays, names=df_columns)

        df_columns = df.columns
        return cast.mapInArrow(run, schema)


def standardized(arrays, means: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised values (0, the mean, where missing) and which are held."""
    x = np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays])
    held = ~np.isnan(x)
    return np.where(held, (x - means) / scales, 0.0), held


def replay(z: np.ndarray, held: np.ndarray, fits: list[np.ndarray]) -> np.ndarray:
    for fit in fits:
        z = np.where(held, z, z @ fit[:, 1:].T + fit[:, 0])
    return z


def fit_imputer(df: DataFrame, columns: list[str], rounds: int = ROUNDS) -> Imputer:
    """Fits of ``rounds`` rounds over all rows of ``df``; one pass a round over a stored
    projection of the columns."""
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    data = scratch_table(df.select(*[F.when(~F.isnan(v), v).alias(f"_i{k}") for k, v in enumerate(value)]), "impute")
    first = data.agg(*[f(f"_i{k}") for k in range(len(columns)) for f in (F.avg, F.stddev_pop)]).first()
    live = [k for k in range(len(columns)) if first[2 * k] is not None]
    means = np.array([first[2 * k] for k in live])
    scales = np.array([first[2 * k + 1] or 1.0 for k in live])
    d, fits = len(live), []
    data = data.select(*[f"_i{k}" for k in live])

    def add_up(fits):
        def run(batches):
            total = np.zeros((d, d + 1, d + 1))
            for b in batches:
                z, held = standardized(b.columns, means, scales)
                z = np.column_stack([np.ones(len(z)), replay(z, held, fits)])
                for j in range(d):
                    rows = z[held[:, j]]
                    total[j] += rows.T @ rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        return run

    for _ in range(rounds if d else 0):
        total = np.zeros(d * (d + 1) ** 2)
        sums = data.mapInArrow(add_up(list(fits)), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        for r in sums.collect():  # d (d + 1)^2 numbers
            total[r["at"]] = r["v"]
        fits.append(np.array([solve(total.reshape(d, d + 1, d + 1)[j], j) for j in range(d)]))
    return Imputer([columns[k] for k in live], means, scales, fits)


def solve(products: np.ndarray, j: int) -> np.ndarray:
    """Coefficients (constant first, 0 for the column itself) of column ``j``."""
    others = np.delete(np.arange(len(products)), j + 1)
    out = np.zeros(len(products))
    out[others] = np.linalg.pinv(products[np.ix_(others, others)], rcond=SINGULAR, hermitian=True) @ products[others, j + 1]
    return out


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``df`` with missing values of ``columns`` filled by regressions on each other."""
    return fit_imputer(df, columns, rounds).transform(df)
