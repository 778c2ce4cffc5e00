"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of hashed word shingles.  Texts with equal sets are one node,
known by the digest of its set.  Nodes that share a band of MinHash values meet
in a bucket; inside it pairs compare their MinHash values a few at a time and are
dropped as soon as the posterior probability that their similarity reaches the
threshold falls below a tolerance.  The pairs that are left are verified on their
shingle sets, so no pair below the threshold is linked.

A bucket with many nodes is split into blocks, and each pair of blocks is a task
of its own, so no task holds a whole bucket.  A pair that shares several bands is
looked at in the first one only.

Links are counted and joined into classes where they are verified; pairs are
given out neither there nor later.

Texts of fewer words than a shingle have one shingle of all their words; texts
without a word are linked to nothing.  Equal rows are copies of each other.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_portions, keep_rows, mix64, row_digest, sized, stored, text_of, WordHashes

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5 values: a pair of similarity 0.8 shares none in 5 of 100,000 cases.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: MinHash values compared at a time; posterior below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-5
#: Nodes in a block of a bucket.
BLOCK = 256

WORD = re.compile(r"[^\W_]+")


def shingle_hashes(text: str, words: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    w = words.of(WORD.findall(text.lower()))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(w[j:len(w) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(mix64(h + np.uint64(k)))


def minhash(x: np.ndarray, multipliers: np.ndarray, masks: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """16 bits of each MinHash value of a shingle set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), chunk):
        y = (x[None, k:k + chunk] ^ masks[:, None]) * multipliers[:, None]
        np.minimum(least, y.min(1), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def hash_family(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    full = np.iinfo(np.uint64).max
    return rng.integers(0, full, HASHES, np.uint64) | np.uint64(1), rng.integers(0, full, HASHES, np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit key of each band of a signature."""
    v = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + v[:, j] + np.uint64(1))
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values, the least number of matches with
    which the posterior of similarity >= threshold stays at or above the
    tolerance, under a uniform prior: P(Beta(m + 1, n - m + 1) >= t) is
    P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rk, node (digest of the shingle set; null without words), its size,
    signature and band keys."""
    def run(batches):
        words, (mult, mask) = WordHashes(), hash_family()
        for b in byte_portions(batches, "t"):
            node, size, sig, keys = [], [], [], []
            for t in b.column("t").to_pylist():
                x = shingle_hashes(t, words)
                size.append(len(x))
                if not len(x):
                    node.append(None)
                    sig.append(None)
                    keys.append(None)
                    continue
                s = minhash(x, mult, mask)
                node.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                sig.append(s.tobytes())
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rk"), pa.array(node, pa.binary()), pa.array(size, pa.int32()),
                 pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "rk", "node", "size", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs, "text").alias("rk"), text_of().alias("t")).mapInArrow(
        run, "doc_id long, rk long, node binary, size int, sig binary, keys array<bigint>")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """Members of buckets with at least two nodes, once for each pair of blocks
    that they belong to: (key, band, bi, bj, blk, node)."""
    at = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    n = at.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = n.withColumnRenamed("key", "_key").withColumnRenamed("band", "_band")
    both = at.join(n, (F.col("key") == F.col("_key")) & (F.col("band") == F.col("_band"))).drop("_key", "_band")
    both = both.withColumn("nb", F.ceil(F.col("n") / BLOCK)).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")))
    both = both.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return both.select("key", "band", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "node")


def groups_of(batches, names: list[str], key: list[str], heavy: str, portion: int = 2000, most: int = 32 << 20):
    """Tables of whole groups from sorted Arrow batches: the rows of a key stay
    together even when they lie in several batches.  A table has about ``portion``
    rows and ``most`` bytes in the binary column ``heavy`` at the most, unless a
    single group has more."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]).select(names)
        t = t if rest is None else pa.concat_tables([rest, t])
        ends = starts_of(t, key)[1:]  # of all groups; the last one may go on in the next batch
        upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(t.column(heavy)), 0).to_numpy(), dtype=np.int64))
        at = 0
        while len(ends) > 1 and at < ends[-2]:
            far = min(at + portion, np.searchsorted(upto, upto[at] + most, "right") - 1)
            end = ends[:-1][max(np.searchsorted(ends[:-1], far, "right") - 1, np.searchsorted(ends[:-1], at, "right"))]
            yield t.slice(at, end - at)
            at = end
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def starts_of(t: pa.Table, key: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    if t.num_rows:
        new[1:] = False
        for k in key:
            c = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def pairs_within(starts: np.ndarray, most: int = 200_000):
    """Index pairs (i < j) inside the groups, in portions of about ``most``."""
    sizes = np.diff(starts)
    for s in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(s, 1)
        at = starts[:-1][sizes == s]
        per = max(1, most // len(i))
        for k in range(0, len(at), per):
            base = at[k:k + per, None]
            yield (base + i).ravel(), (base + j).ravel()


KEY = ["key", "band", "bi", "bj"]


def prune(batches):
    """Surviving pairs of each bucket block, as one row for each node involved:
    its place in the block and the places of its partners after it."""
    need = least_matches()
    names = [*KEY, "blk", "node", "size", "sig"]
    for t in groups_of(batches, names, KEY, "sig"):
        starts = starts_of(t, KEY)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        size = t.column("size").to_numpy()
        band, blk, bi, bj = (t.column(c).to_numpy() for c in ("band", "blk", "bi", "bj"))
        left, right = [], []
        for i, j in pairs_within(starts):
            # pairs inside one block belong to the task (block, block) alone
            ok = (blk[i] != blk[j]) | (bi[i] == bj[i])
            ok &= np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[ok], j[ok]
            got = np.zeros(len(i), np.int32)
            for n in range(STEP, HASHES + 1, STEP):
                if not len(i):
                    break
                equal = sig[i, n - STEP:n] == sig[j, n - STEP:n]
                got += equal.sum(1)
                shared = equal.reshape(len(i), -1, ROWS).all(2)
                earlier = (shared & (np.arange((n - STEP) // ROWS, n // ROWS)[None, :] < band[i][:, None])).any(1)
                ok = (got >= need[n]) & ~earlier
                i, j, got = i[ok], j[ok], got[ok]
            left.append(i)
            right.append(j)
        if not left:
            continue
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        rows = np.union1d(i, j)
        first = starts[np.searchsorted(starts, rows, "right") - 1]
        partner = j - starts[np.searchsorted(starts, j, "right") - 1]
        offsets = np.append(np.searchsorted(i, rows), len(i))
        out = t.select([*KEY, "node"]).take(pa.array(rows))
        out = out.append_column("place", pa.array(rows - first, pa.int32()))
        out = out.append_column("partners", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(partner, pa.int32())))
        yield from out.combine_chunks().to_batches()


def verify(batches):
    """Exact similarity of the surviving pairs of each bucket block: one row for
    each node with a pair at or above the threshold.  ``near`` counts the
    documents of its partners in this block, ``link`` is another node of its
    component (null for one node of it); no pair is given out."""
    names = [*KEY, "node", "place", "partners", "x", "copies"]
    for t in groups_of(batches, names, KEY, "x"):
        starts = starts_of(t, KEY)
        node, sets = t.column("node").to_pylist(), t.column("x").to_pylist()
        place, copies = t.column("place").to_numpy(), t.column("copies").to_numpy()
        lists = t.column("partners").combine_chunks()
        partners, of = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        out_node, out_near, out_link = [], [], []
        for s, e in zip(starts[:-1], starts[1:]):
            row_of = np.full(place[s:e].max() + 1, -1)
            row_of[place[s:e]] = np.arange(e - s)
            parts = [np.frombuffer(x, np.uint64) for x in sets[s:e]]
            at = np.append(0, np.cumsum([len(x) for x in parts]))
            distinct, ids = np.unique(np.concatenate(parts), return_inverse=True)
            mark, near = np.zeros(len(distinct), bool), np.zeros(e - s, np.int64)
            root, link = list(range(e - s)), [None] * (e - s)

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for i in range(e - s):
                with_ = row_of[partners[of[s + i]:of[s + i + 1]]]
                if not len(with_):
                    continue
                n = at[with_ + 1] - at[with_]
                begin = np.append(0, np.cumsum(n)[:-1])
                mine = ids[at[i]:at[i + 1]]
                mark[mine] = True
                both = np.add.reduceat(mark[np.concatenate([ids[at[k]:at[k + 1]] for k in with_])], begin, dtype=np.int64)
                mark[mine] = False
                hit = with_[both >= THRESHOLD * (n + len(mine) - both) - 1e-9]
                near[i] += copies[s + hit].sum()
                near[hit] += copies[s + i]
                for k in hit:
                    a, b = find(i), find(int(k))
                    if a != b:
                        root[b], link[b] = a, node[s + a]
            for k in np.flatnonzero(near):
                out_node.append(node[s + k])
                out_near.append(int(near[k]))
                out_link.append(link[k])
        yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.binary()), pa.array(out_near, pa.int64()), pa.array(out_link, pa.binary())],
                                         ["node", "near", "link"])


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, near, link): by bucket block, the documents linked to a node and
    one edge of a spanning forest of its links."""
    spark = docs.sparkSession
    members = bucket_members(nodes)
    sigs = nodes.select(F.col("node").alias("_n"), "size", "sig")
    members = members.join(sigs, F.col("node") == F.col("_n")).drop("_n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = members.repartition(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(
        prune, "key bigint, band int, bi bigint, bj bigint, node binary, place int, partners array<int>")
    left = stored(left, "survivors")

    # shingle sets of the nodes involved, from one document each
    involved = left.select("node").distinct().join(nodes.select(F.col("node").alias("_n"), "rep", "copies"), F.col("node") == F.col("_n"))
    involved = stored(involved.select("node", "copies", F.col("rep.doc_id").alias("_id"), F.col("rep.rk").alias("_rk")), "involved")

    def sets(batches):
        words = WordHashes()
        for b in byte_portions(batches, "t"):
            x = [shingle_hashes(t, words).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), pa.array(x, pa.binary())], ["_n", "copies", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(docs, "text").alias("rk"), text_of().alias("t"))
    texts = texts.join(sized(involved), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")))
    # rows equal in id and text give the same set
    x = texts.select("node", "copies", "t").mapInArrow(sets, "_n binary, copies long, x binary").dropDuplicates(["_n"])
    ready = left.join(x, F.col("node") == F.col("_n")).drop("_n")
    return ready.repartition(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(verify, "node binary, near long, link binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the least node of their
    connected component, by alternating large-star and small-star steps."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def mark(d: DataFrame):
        return d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("_u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-star")
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        e = stored(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, rk, class_id, n_copies and n_links of every document.

    class_id: the least doc_id of the document's connected component (its own id
    without a link); n_copies: documents with the same shingle set, itself
    included; n_links: other documents at or above the threshold."""
    rows = stored(signatures(docs), "signatures")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "rk")).alias("rep"), F.first("size").alias("size"),
        F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = stored(nodes, "nodes")
    found = stored(links(docs, nodes), "links")
    near = found.groupBy(F.col("node").alias("_a")).agg(F.sum("near").alias("near"))
    forest = found.where(F.col("link").isNotNull()).select(F.col("node").alias("a"), F.col("link").alias("b"))
    comp = components(forest).withColumnRenamed("node", "_c")
    info = nodes.select("node", "copies", "rep").join(near, F.col("node") == F.col("_a"), "left").join(comp, F.col("node") == F.col("_c"), "left")
    info = info.select("node", "copies", "rep", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "node").alias("root"))
    info = stored(info, "node-info")
    first = info.groupBy(F.col("root").alias("_r")).agg(F.min("rep").alias("first"))
    info = info.join(first, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), "copies", "near", "first")
    out = rows.select("doc_id", "rk", "node").join(info, F.col("node") == F.col("_n"), "left")
    return out.select(
        "doc_id", "rk",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rk") == F.col("first.rk")))).alias("is_first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class (the one of least id), with its own columns."""
    found = stored(near_duplicates(docs), "classes")
    gone = stored(found.where(~F.col("is_first")).select(F.col("doc_id").alias("_cx_id"), F.col("rk").alias("_cx_rk")).distinct(), "duplicates")
    out = keep_rows(docs, gone, "text")
    # rows equal in id and text are all first: number them where there are any
    repeated = found.where(F.col("is_first") & (F.col("n_copies") > 1)).groupBy("doc_id", "rk").count().where("count > 1")
    if repeated.head(1):
        w = Window.partitionBy("doc_id", row_digest(docs, "text")).orderBy(F.lit(1))
        names = [F.col(f"`{c}`") for c in docs.columns]
        out = out.withColumn("_cx_n", F.row_number().over(w)).where(F.col("_cx_n") == 1).select(*names)
    return out
