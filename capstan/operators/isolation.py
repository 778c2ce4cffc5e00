"""Outliers by isolation: trees of random splits on small samples, where a row that is
split off early is unlike the others.

Each tree grows on its own part of a seeded sample of ``trees * rows`` rows (a bound on
what reaches the driver, whatever the table's size); all rows are scored, in Arrow
batches, by the average length of their paths.  Scores lie between 0 and 1; ordinary
rows are near or below 0.5.  A row that is extreme in one column only can rank behind
rows at the edge of several.

A row with a null among the columns has a null score and is not sampled; a table
without complete rows scores null everywhere.  The sample, and so the scores, agree
between runs over the same files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Trees, and rows that each is grown on.
TREES, ROWS = 100, 256
EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Average length of a failed search in a binary search tree of ``n`` keys."""
    return 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass(frozen=True)
class Forest:
    """Trees as one table of nodes: a leaf has itself on both sides and its path
    length; ``roots`` are the first nodes of the trees."""

    columns: list[str]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    path: np.ndarray
    depth: int
    scale: float


def fit_isolation(df: DataFrame, columns: list[str], trees: int = TREES, rows: int = ROWS, seed: int = 42) -> Forest:
    """A forest grown on a seeded sample of complete rows."""
    full = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(columns)]).dropna()
    n, most = full.count(), trees * rows
    taken = full if n <= most else full.sample(fraction=most / n, seed=seed)
    x = np.array([tuple(r) for r in taken.collect()], float).reshape(-1, len(columns))  # about trees * rows
    x = x[np.lexsort(x.T[::-1])] if len(x) else x  # the order of arrival plays no part
    draw = np.random.Generator(np.random.PCG64(seed))
    rows = min(rows, len(x))
    limit = max(1, math.ceil(math.log2(max(2, rows))))
    nodes: list[list] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, depth + average_path(len(part))])
        least, most_ = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(most_ > least)
        if depth < limit and len(wide):
            f = int(draw.choice(wide))
            cut = draw.uniform(least[f], most_[f])
            below = part[:, f] < cut
            nodes[at][:4] = [f, cut, grow(part[below], depth + 1), grow(part[~below], depth + 1)]
        return at

    roots = [grow(x[draw.choice(len(x), rows, replace=False)], 0) for _ in range(trees)] if len(x) else []
    table = list(zip(*nodes)) if nodes else [()] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(list(columns), np.array(roots, np.int64), *[np.array(c, k) for c, k in zip(table, kinds)], limit, max(average_path(rows), 1e-9) if rows else 1.0)


def isolation_scores(df: DataFrame, forest: Forest, out: str = "isolation_score") -> DataFrame:
    """``df`` with the score of every row."""
    roots, feature, cut, low, high, path, depth, scale = (
        forest.roots, forest.feature, forest.cut, forest.low, forest.high, forest.path, forest.depth, forest.scale)

    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        row, total = np.arange(len(x)), np.zeros(len(x))
        for root in roots:
            node = np.full(len(x), root)
            for _ in range(depth):
                node = np.where(x[row, feature[node]] < cut[node], low[node], high[node])
            total += path[node]
        held = ~np.isnan(x).any(axis=1) & bool(len(roots))
        return pd.Series(np.where(held, 2.0 ** (-total / max(1, len(roots)) / scale), np.nan)).astype(object).where(held, None)

    scored = F.pandas_udf(score, "double")(*[F.col(f"`{c}`").cast("double") for c in forest.columns])
    return df.withColumn(out, scored)
