"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (1 to 4
characters, with word borders); a linear layer and softmax give the language.
Both are trained by stochastic gradient descent in numpy on a bounded sample.
A temperature and a rejection threshold are set on a part of the sample that was
not trained on.

Because the layer is linear, embedding and layer fold into one table of scores by
n-gram hash, so a text's scores are the mean of its rows in that table.

Edge cases: texts that are null or have no letter are ``und`` with score 0; ties
go to the first language by name; without a labelled row all are ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, fold_of, mix64, row_digest, text_of

#: Bound of the training sample, in documents of all languages together.
SAMPLE_DOCS = 2000
#: Hash space, embedding width.
HASH_BITS, WIDTH = 14, 16
BUCKETS = 1 << HASH_BITS
ORDERS = (1, 2, 3, 4)
#: Share of the training sample that is kept for calibration, and the share of
#: right calibration documents that may be rejected.
CALIBRATE, REJECT_RIGHT = 0.2, 0.01

LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def gram_hashes(text: str) -> np.ndarray:
    """Hash buckets of all n-grams of the lower-cased text."""
    s = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    x = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in ORDERS:
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1:]
        out.append((mix64(h + np.uint64(n << 40)) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(out)


def sample(docs: DataFrame, usable, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most about ``most`` usable rows, spread over the languages, chosen by a
    hash of the row (a smaller language keeps a larger share of its rows)."""
    rows = docs.where(usable)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count")).limit(most).collect()}
    if not counts:
        return rows.limit(0)
    each = most / len(counts)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    u = F.pmod(row_digest(docs, "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(u < share)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, seed: int = 7,
          epochs: int = 12, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and layer by SGD over documents; a bag is (buckets, shares)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1.0 / WIDTH, 1.0 / WIDTH, (BUCKETS, WIDTH))
    layer = np.zeros((WIDTH, n_classes))
    class_weight = len(y) / (n_classes * np.maximum(1, np.bincount(y, minlength=n_classes)))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = rate * (1 - done / steps)
            done += 1
            at, share = bags[i]
            v = share @ emb[at]
            z = v @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= class_weight[y[i]]
            back = layer @ p
            layer -= step * np.outer(v, p)
            # a bag's shares are small: the embeddings take a longer step
            emb[at] -= step * 30 * np.outer(share, back)
    return emb, layer


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the confidence that all but
    ``REJECT_RIGHT`` of the rightly classified documents reach."""
    if not len(y):
        return 1.0, 0.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        a = z / t
        a = a - a.max(1, keepdims=True)
        loss = (np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]).mean()
        best = min(best, (loss, t))
    a = np.exp((z - z.max(1, keepdims=True)) / best[1])
    p = a / a.sum(1, keepdims=True)
    right = p.argmax(1) == y
    return best[1], float(np.quantile(p.max(1)[right], REJECT_RIGHT)) if right.any() else 0.0


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (confidence below the
    calibrated threshold) of every document; learns from the other folds."""
    usable = (fold_of(modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    picked = sample(docs, usable, most)

    def to_bags(batches):
        for b in byte_portions(batches, "text"):
            at, share = [], []
            for t in b.column("text").to_pylist():
                g = np.bincount(gram_hashes(t), minlength=BUCKETS) if LETTER.search(t) else np.zeros(BUCKETS)
                k = np.flatnonzero(g)
                at.append(k.astype(np.int32).tobytes())
                share.append((g[k] / max(1, g.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.array(at, pa.binary()), pa.array(share, pa.binary())],
                                             ["lang", "u", "at", "share"])

    u = row_digest(docs, "doc_id", "text").alias("u")
    got = picked.select("text", "lang", u).mapInArrow(to_bags, "lang string, u long, at binary, share binary").collect()
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["u"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    scores, temperature, threshold = np.zeros((BUCKETS, max(1, len(langs))), np.float32), 1.0, 0.0
    if langs:
        bags = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32).astype(float)) for r in got]
        y = np.array([langs.index(r["lang"]) for r in got])
        apart = np.array([(r["u"] // 7919) % 100 < 100 * CALIBRATE for r in got])
        fit = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
        emb, layer = train([bags[i] for i in fit], y[fit], len(langs))
        scores = (emb @ layer).astype(np.float32)
        z = np.array([s @ scores[at] for at, s in (bags[i] for i in np.flatnonzero(apart))]).reshape(-1, len(langs))
        temperature, threshold = calibrate(z, y[apart])
    # the table has BUCKETS rows whatever the input: a broadcast of fixed size
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def predict(batches):
        table = shared.value
        for b in byte_portions(batches, "t"):
            pred, score = [], []
            for t in b.column("t").to_pylist():
                if not langs or not LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                z = class_scores(t, table) / temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                pred.append(langs[k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array([s < threshold for s in score], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(modulus) == held).alias("held_out"), text_of().alias("t")) \
        .mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def class_scores(text: str, scores: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over all n-grams of the text."""
    counts = np.bincount(gram_hashes(text), minlength=len(scores))
    k = np.flatnonzero(counts)
    return (counts[k] / counts.sum()) @ scores[k]
