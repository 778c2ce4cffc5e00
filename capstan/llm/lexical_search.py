"""Ranked lexical search by dense blocked matrix products.

The terms of the items are a small vocabulary.  One pass over the texts keeps, for
each document, its length and the counts of those terms.  A second pass over these
narrow rows multiplies blocks: a tile of documents (rows of term impacts) times a
tile of items (columns of term weights over the items' own compact vocabulary), in
float64.  Impacts and weights are integers, and a tile spans only so many terms that
a sum stays below 2^53, so every product is exact in any order of summation; the
tiles of one item are added as 64-bit integers.  Each task keeps the best documents
of every item, ties by the lesser doc_id, and gives out no more than those; they are
merged in two steps.

Score of a document for an item, all in integers but the logarithm: the sum over
the item's terms, once each, of w * ((10^9 tf) div (1000 tf + 8 m)), with
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L.

Items are taken in groups of about ``GROUP_TERMS`` (item, term) rows, counted; each
group is one pass over the texts.  Only a group's terms travel to the tasks.

Edge cases: a null or empty text has no term, is not counted in N and is never
found; an item without terms finds nothing; the texts of rows with one item_id are
one item, null among the ids; repeated documents rank each for itself; of equal
scores a null doc_id ranks last; empty tables give an empty result.  ``doc_id`` and
``item_id`` are integers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_portions, stored

#: (item, term) rows of a group of items: what a task holds of the query side.
GROUP_TERMS = 200_000
#: Documents, terms and items of a tile.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 512, 2048, 256
#: Impacts stay below this: m is 10 or more.
MAX_IMPACT = 1_000_000
#: Integers below this are exact in float64.
EXACT = 1 << 53
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
#: Buckets of the first merge.
SALTS = 64

#: ASCII letters and digits and all other characters are kept, A-Z as a-z.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

FOUND = "item_id long, doc_id long, score long"


def term_counts(data: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs."""
    data, counts, n, start = data.translate(FOLD), Counter(), 0, 0
    while start < len(data):
        stop = data.find(b" ", start + CHUNK) if len(data) - start > CHUNK else -1
        words = data[start:stop if stop >= 0 else None].split()
        counts.update(words)
        n += len(words)
        start = stop if stop >= 0 else len(data)
    return n, counts


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) rows; a term as its UTF-8 bytes."""

    def run(batches):
        for b in byte_portions(batches, "t"):
            ids, terms = [], []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("t").to_pylist()):
                found = list(term_counts(t)[1])
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def document_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the vocabulary's terms with their counts, of documents with at
    least one term."""

    def run(batches):
        number = vocabulary.get
        for b in byte_portions(batches, "t"):
            ids, sizes, terms, counts = [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist()):
                n, found = term_counts(t)
                if n:
                    held = [(k, tf) for word, tf in found.items() if (k := number(word)) is not None]
                    ids.append(i)
                    sizes.append(n)
                    terms.append([k for k, _ in held])
                    counts.append([tf for _, tf in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def tiles_of(item_terms: list[np.ndarray], weights: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Tiles of items: their numbers, and per tile of their compact vocabulary its
    terms and the (term in tile, item in tile) places of the weights."""
    most = max(1, min(TILE_TERMS, (EXACT - 1) // (MAX_IMPACT * max(1, int(weights.max(initial=1))))))
    out = []
    for first in range(0, len(item_terms), TILE_ITEMS):
        held = item_terms[first:first + TILE_ITEMS]
        numbers = np.arange(first, first + len(held))
        term, item = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
        vocabulary = np.unique(term)
        place, parts = np.searchsorted(vocabulary, term), []
        for k in range(0, len(vocabulary), most):
            here = (place >= k) & (place < k + most)
            parts.append((vocabulary[k:k + most], place[here] - k, item[here]))
        out.append((numbers, parts))
    return out


class Best:
    """The ``k`` best documents of each item, as triplets sorted by item, then by
    falling score, null ids last and rising id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.ones(n_items, np.int64)  # the least score that can still rank
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, -score, id is null, id

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, (item, -score, null, ids))]
        order = np.lexsort(rows[::-1])
        rows = [x[order] for x in rows]
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        self.rows = [x[rank < self.k] for x in rows]
        last = rank == self.k - 1
        self.floor[rows[0][last]] = -rows[1][last]


def search_tiles(item_ids: list, item_terms: list[np.ndarray], weights: np.ndarray, k: int):
    """Task function: rows (doc_id, m, terms, tf) to each item's ``k`` best."""
    tiles = tiles_of(item_terms, weights)

    def run(batches):
        best, place = Best(len(item_ids), k), np.full(len(weights), -1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 8 * TILE_DOCS):
                block(batch.slice(start, 8 * TILE_DOCS), best, place)
        item, score, null, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([item_ids[i] for i in item], pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(-score, pa.int64())],
            ["item_id", "doc_id", "score"])

    def block(b, best, place):
        m, terms = b.column("m").to_numpy(), b.column("terms")
        null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = b.column("doc_id").fill_null(0).to_numpy()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(b.num_rows), sizes)
        term, tf = terms.flatten().to_numpy(), b.column("tf").flatten().to_numpy()
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        bounds = np.searchsorted(row, np.arange(0, b.num_rows + TILE_DOCS, TILE_DOCS))
        for numbers, parts in tiles:
            dense = []
            for vocabulary, at, item in parts:
                w = np.zeros((len(vocabulary), len(numbers)))
                w[at, item] = weights[vocabulary[at]]
                dense.append((vocabulary, w))
            for t in range(len(bounds) - 1):
                first, own = t * TILE_DOCS, slice(bounds[t], bounds[t + 1])
                n_docs = min(TILE_DOCS, b.num_rows - first)
                total = np.zeros((n_docs, len(numbers)), np.int64)
                for vocabulary, w in dense:
                    place[vocabulary] = np.arange(len(vocabulary))
                    column = place[term[own]]
                    held = column >= 0
                    d = np.zeros((n_docs, len(vocabulary)))
                    d[row[own][held] - first, column[held]] = impact[own][held]
                    total += (d @ w).astype(np.int64)
                    place[vocabulary] = -1
                doc, item = np.nonzero(total >= best.floor[numbers])
                if len(doc):
                    best.add(numbers[item], total[doc, item], null[first + doc], ids[first + doc])

    return run


def merged(parts: DataFrame, k: int) -> DataFrame:
    """Each item's ``k`` best of the tasks' bests, first by buckets of documents."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    first = parts.withColumn("_cx_s", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_cx_s").orderBy(*order)))
    first = first.where(F.col("rank") <= k).drop("rank", "_cx_s")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return out.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents
    with a score above 0."""
    spark = docs.sparkSession
    pairs = stored(item_terms(items), "item-terms")
    n_groups = -(-pairs.count() // group_terms)
    found = spark.createDataFrame([], FOUND)
    for g in range(n_groups):
        of_group = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g).collect()  # about group_terms rows
        found = found.unionByName(search_group(spark, docs, [(r["item_id"], bytes(r["term"])) for r in of_group], k))
    return merged(found, k)


def search_group(spark: SparkSession, docs: DataFrame, pairs: list[tuple], k: int) -> DataFrame:
    """The tasks' bests for the items of one group."""
    vocabulary = {term: number for number, term in enumerate(sorted({term for _, term in pairs}))}
    by_item: dict = {}
    for item, term in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        by_item.setdefault(item, []).append(vocabulary[term])
    counts = stored(document_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not by_item:
        return spark.createDataFrame([], FOUND)
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term at most
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    m = F.expr(f"10 + cast((cast(n as decimal(18,0)) * 90 * cast({n_docs} as decimal(17,0))) div cast({n_terms} as decimal(20,0)) as long)")
    rows = counts.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tf")
    run = search_tiles(list(by_item), [np.array(t, np.int64) for t in by_item.values()], weights, k)
    return stored(rows.mapInArrow(run, FOUND), "bests")
