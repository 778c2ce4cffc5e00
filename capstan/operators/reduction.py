"""Principal components from a covariance matrix summed over Arrow batches.

The matrix (see :mod:`capstan.operators.moments`) is as wide as the list of columns,
whatever the number of rows; its eigenvectors are found on the driver, and rows are
projected by column expressions.  Covariances are those of pairwise complete rows; a
row with a null in any column has null scores.  A component's first loading that is
not 0 is positive, so reruns agree.  Constant columns are left unscaled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import moments


@dataclass(frozen=True)
class Components:
    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    loadings: np.ndarray  # a row a component
    variances: np.ndarray
    total: float

    def table(self, spark) -> DataFrame:
        """``component`` (from 1), ``variance`` and its ``share`` of the whole."""
        rows = [(k + 1, float(v), float(v / self.total) if self.total else None) for k, v in enumerate(self.variances)]
        return spark.createDataFrame(rows, "component int, variance double, share double")

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """``df`` with the scores ``<prefix>1``, ``<prefix>2`` ..."""
        x = [(F.col(f"`{c}`").cast("double") - float(m)) / float(s) for c, m, s in zip(self.columns, self.means, self.scales)]
        return df.select("*", *[sum((float(w) * c for w, c in zip(row, x)), F.lit(0.0)).alias(f"{prefix}{k + 1}") for k, row in enumerate(self.loadings)])


def principal_components(df: DataFrame, columns: list[str], k: int | None = None, standardize: bool = True) -> Components:
    """The first ``k`` (by default all) components of ``columns``."""
    means, n, s, _, p = moments(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = np.nan_to_num((p - s * s.T / n) / np.where(n > 1, n - 1, np.nan))
    scales = np.where(cov.diagonal() > 0, np.sqrt(np.maximum(cov.diagonal(), 0)), 1.0) if standardize else np.ones(len(columns))
    cov = cov / np.outer(scales, scales)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, order].T
    for row in loadings:
        first = row[np.flatnonzero(np.abs(row) > 1e-9)[:1]]
        row *= -1.0 if len(first) and first[0] < 0 else 1.0
    return Components(list(columns), means, scales, loadings, np.maximum(values[order], 0.0), float(np.trace(cov)))
