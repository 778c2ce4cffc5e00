"""Minority oversampling (F-27): synthetic rows on the segments between a
minority row and one of its k nearest minority neighbours, until the
minority class is as large as the majority class.

The k nearest neighbours are EXACT and found with a grid, not by pairing rows:

1. rows at one point are one point with its k + 1 least ids; points are dealt into
   the cells of a grid over the (at most three) widest features; the grid is made
   finer until no cell holds more than ``CELL_MAX`` points (or it can get no finer);
2. a point looks into its own and the neighbouring cells: blocks of cells are dealt to
   tasks with a rim of copies, so a point is shuffled once or a few times and no pair is.
   Every point outside them is further away than their rim, so the nearest found
   are exact when the last of them is nearer than the rim;
3. points not yet proven look again in cells twice as wide, until none is left; a
   cell as wide as the data holds everything.  Those are points in thin regions, so
   wide cells hold few points where they look, and only blocks where one looks are dealt.

A block with more than ``BLOCK_POINTS`` points is dealt in slices, whose nearest points
are put together.

Randomness (base row, neighbour, interpolation weight) comes from
``xxhash64`` of the synthetic row number and the seed, so the result does
not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_table, sized
from .windows import dense_position

K = 5
SEED = 42
#: Distinct points of an average cell of the first grid, and of any cell of the
#: grid that is looked into first.
CELL_ROWS, CELL_MAX = 4, 64
#: Halvings of the cell width at most.
FINEST = 40
#: Features that span the grid; distances always use all features.
GRID_DIMS = 3
#: Cells along the side of a block of the first grid, points of a slice of a block, and
#: distances that a task holds at a time.
BLOCK_SIDE, BLOCK_POINTS, HELD = 8, 50_000, 1 << 21


def nearest_neighbours(points: DataFrame, k: int, id_col: str = "_id", x_col: str = "_x") -> DataFrame:
    """(id, x, nn) and the other columns of ``points``, with ``nn`` the k nearest other
    points (struct of distance, id, x), exact Euclidean, ties by id."""
    others = [c for c in points.columns if c not in (id_col, x_col)]
    rows = scratch_table(points.select(F.col(id_col).alias("_id"), F.col(x_col).alias("_x"), *others), "points")
    dim = len(rows.select("_x").first()["_x"])      # one row: the vector length
    first = Window.partitionBy("_x").orderBy("_id")
    spots = rows.select("_id", "_x").withColumn("_rn", F.dense_rank().over(first)).where(F.col("_rn") <= k + 1)
    spots = scratch_table(spots.groupBy("_x").agg(F.array_sort(F.collect_set("_id")).alias("_ids")), "spots")  # k + 1 ids at most
    ends = spots.agg(*[f(F.col("_x")[i]).alias(f"{n}{i}") for i in range(dim) for n, f in (("lo", F.min), ("hi", F.max))],
                     F.count(F.lit(1)).alias("n")).first()
    spans = sorted(((ends[f"hi{i}"] - ends[f"lo{i}"], i) for i in range(dim)), reverse=True)[:GRID_DIMS]
    axes = [(i, ends[f"lo{i}"], w) for w, i in spans if w > 0]
    cells = max(1.0, (ends["n"] / CELL_ROWS) ** (1.0 / max(1, len(axes))))
    for _ in range(FINEST if axes else 0):
        per = spots.groupBy(*[_cell(i, lo, w / cells) for i, lo, w in axes]).agg(F.count(F.lit(1)).alias("n"))
        if per.agg(F.max("n")).first()[0] <= CELL_MAX:
            break
        cells *= 2.0
    todo, found, side = spots.select("_x"), None, BLOCK_SIDE
    while True:
        near, reach = _near(todo, spots, axes, {i: w / cells for i, _, w in axes}, k, dim, side)
        whole = cells <= 1.0 or not axes
        proven = F.lit(True) if whole else (F.size("_d") > k) & (F.get("_d", F.lit(k)) < reach * (1 - 1e-12))
        ok = scratch_table(near.where(proven), "neighbours")
        found = ok if found is None else found.unionByName(ok)
        if whole:
            break
        todo = scratch_table(todo.join(ok.select("_x"), "_x", "left_anti"), "unproven")
        if todo.isEmpty():
            break
        cells, side = cells / 2.0, 1
    # k + 1 nearest points with the row's own one; equal ids are one row
    other = F.filter(F.sequence(F.lit(0), F.size("_d") - 1), lambda i: ~F.col("_id").eqNullSafe(F.get("_near", i)))
    nn = F.transform(F.slice(other, 1, k), lambda i: F.struct(F.get("_d", i).alias("d"), F.get("_near", i).alias("id"),
                                                               F.slice("_at", i * dim + 1, dim).alias("x")))
    out = rows.join(found, "_x").select("_id", "_x", *others, F.when(F.size("_d") > 0, nn).otherwise(F.slice(nn, 1, 0)).alias("nn"))
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_x", x_col)


def _cell(i: int, lo: float, width: float) -> Column:
    return F.floor((F.col("_x")[i] - lo) / width).cast("long")


def _nearest(k: int, dim: int):
    """Of one slice of a block: the k + 1 nearest rows of each point that looks."""
    def run(pdf):
        looks = pdf["_looks"].to_numpy(dtype=bool)
        q, held = (pdf.loc[m].reset_index(drop=True) for m in (looks, ~looks))
        x, c = (np.array(d["_x"].tolist(), dtype=float).reshape(-1, dim) for d in (q, held))
        counts = held["_ids"].str.len().to_numpy(dtype=int) if len(held) else np.zeros(0, int)
        starts = np.cumsum(counts) - counts
        ids = np.concatenate(held["_ids"].tolist()) if len(held) else np.zeros(0)
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        out = []
        for lo in range(0, len(x), max(1, HELD // max(1, len(c)))):
            part = x[lo:lo + max(1, HELD // max(1, len(c)))]
            d = np.zeros((len(part), len(c)))
            for j in range(dim):
                d += (part[:, j:j + 1] - c[None, :, j]) ** 2
            d = np.sqrt(d)
            far = np.partition(d, k, axis=1)[:, k] if len(c) > k + 1 else np.full(len(part), np.inf)
            for i in range(len(part)):
                at = np.flatnonzero(~(d[i] > far[i]))  # with all that are as far as the last
                n = counts[at]
                where = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                spot, dist = np.repeat(at, n), np.repeat(d[i][at], n)
                best = np.lexsort((rank[where], dist))[:k + 1]
                out.append((dist[best], ids[where[best]], c[spot[best]].ravel()))
        q = q[["_x"]]
        for n, name in enumerate(("_d", "_near", "_at")):
            q[name] = pd.Series([o[n] for o in out], index=q.index, dtype=object)
        return q
    return run


def _near(looking: DataFrame, spots: DataFrame, axes, width, k: int, dim: int, side: int) -> tuple[DataFrame, Column]:
    """Points that look with the distances, ids and (flat) vectors of the k + 1 nearest
    rows in their own and the neighbouring cells, and the distance up to which that is
    everything."""
    names = [f"_b{i}" for i, _, _ in axes] or ["_b"]
    cell = {i: _cell(i, lo, width[i]) for i, lo, _ in axes}
    block = lambda c: F.floor(c / side).cast("long")
    mine = looking.select("_x", *([block(cell[i]).alias(f"_b{i}") for i in cell] or [F.lit(0).cast("long").alias("_b")]))
    there = spots if axes else spots.withColumn("_b", F.lit(0).cast("long"))
    for i in cell:
        there = there.withColumn(f"_b{i}", F.explode(F.array_distinct(F.array(*[block(cell[i] + o) for o in (-1, 0, 1)]))))
    if side == 1:
        there = there.join(sized(scratch_table(mine.select(*names).distinct(), "blocks")), names, "left_semi")
    there = there.select("_x", "_ids", *names)
    most = there.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    slices = -(-most // BLOCK_POINTS) or 1
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    u = there.withColumn("_slice", F.pmod(F.xxhash64("_x"), F.lit(slices)).cast("int")).withColumn("_looks", F.lit(False)).unionByName(
        mine.withColumn("_slice", every).withColumn("_looks", F.lit(True)), allowMissingColumns=True)
    one = spots.schema["_ids"].dataType.elementType
    reals = T.ArrayType(T.DoubleType())
    near = u.groupBy(*names, "_slice").applyInPandas(_nearest(k, dim), T.StructType([
        T.StructField("_x", reals), T.StructField("_d", reals), T.StructField("_near", T.ArrayType(one)), T.StructField("_at", reals)]))
    if slices > 1:
        each = F.transform(F.sequence(F.lit(1), F.size("_d")), lambda i: F.struct(
            F.get("_d", i - 1).alias("d"), F.get("_near", i - 1).alias("id"), F.slice("_at", (i - 1) * dim + 1, dim).alias("x")))
        best = F.slice(F.array_sort(F.flatten(F.collect_list("_all"))), 1, k + 1)  # k + 1 a slice
        near = near.where(F.size("_d") > 0).select("_x", each.alias("_all")).groupBy("_x").agg(best.alias("_all")).select(
            "_x", F.transform("_all", lambda e: e["d"]).alias("_d"), F.transform("_all", lambda e: e["id"]).alias("_near"),
            F.flatten(F.transform("_all", lambda e: e["x"])).alias("_at"))
    # distance to the rim of the ring: a whole cell beyond the row's own one
    rim = [F.least((F.col("_x")[i] - lo) - F.floor((F.col("_x")[i] - lo) / width[i]) * width[i] + width[i],
                   (F.floor((F.col("_x")[i] - lo) / width[i]) + 2) * width[i] - (F.col("_x")[i] - lo)) for i, lo, _ in axes]
    return near, F.least(*rim) if len(rim) > 1 else (rim[0] if rim else F.lit(0.0))


def oversample(df: DataFrame, features, label: str, k: int = K, seed: int = SEED, id_col: str = "event_id") -> DataFrame:
    """F-27: the original rows (``synthetic`` false) plus
    ``n_majority - n_minority`` synthetic minority rows ``a + u (b - a)``.
    Rows with a NULL feature are kept but not used as base or neighbour."""
    counts = sorted(df.groupBy(label).count().collect(), key=lambda r: (r["count"], str(r[label])))
    base = df.select(*features, label, F.lit(False).alias("synthetic"))
    if len(counts) < 2:
        return base
    minority, n_maj = counts[0][label], counts[-1]["count"]
    x = F.array(*[F.col(c).cast("double") for c in features])
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull()
    mino = scratch_table(df.where((F.col(label) == minority) & ok).select(F.col(id_col).alias("_id"), x.alias("_x")), "minority")
    n_min = mino.count()
    need = n_maj - counts[0]["count"]
    if need <= 0 or n_min < 2:
        return base
    kk = min(k, n_min - 1)
    nn = nearest_neighbours(dense_position(mino, [], ["_id"], "_bpos"), kk).select("_bpos", F.col("_x").alias("_a"), "nn")
    spark = df.sparkSession
    s = spark.range(need).select(F.col("id").alias("_s"))
    s = s.select("_s", F.pmod(F.xxhash64("_s", F.lit(seed)), F.lit(n_min)).alias("_bpos"),
                 F.pmod(F.xxhash64("_s", F.lit(seed + 1)), F.lit(kk)).alias("_pick"),
                 (F.pmod(F.xxhash64("_s", F.lit(seed + 2)), F.lit(1_000_000)) / 1_000_000.0).alias("_u"))
    j = s.join(nn, "_bpos")
    # rows of one id are one neighbour, so there may be fewer than kk; without any the row is its own
    b = F.coalesce(F.get("nn", F.pmod("_pick", F.greatest(F.size("nn"), F.lit(1))).cast("int"))["x"], "_a")
    syn = j.select(F.zip_with("_a", b, lambda a, bb: a + F.col("_u") * (bb - a)).alias("_v"))
    rows = syn.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(features)],
                      F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(True).alias("synthetic"))
    return base.unionByName(rows)
