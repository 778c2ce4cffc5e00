"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

The features are densities of lexicon words (a short fixed list, and a lexicon
induced from labelled training rows), their nearness to second-person words,
and rates of capitals, punctuation and obfuscated spellings.  Training rows are a
bounded sample, split by hash into three parts: one for the lexicon, one for the
trees, one for the calibration.

Edge cases: a null text counts as empty and is scored like any text; documents
with several label rows are toxic if one row says so; without labels of both
classes the score is the share of toxic rows (0 without any); an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_portions, fold_of, stored, text_of

#: Bounds of the training sample (rows with a label) and of the induced lexicon.
SAMPLE_ROWS = 15_000
LEXICON_TERMS = 4_000
#: Parts of the sample in hundredths: lexicon, trees; the rest calibrates.
LEXICON_PART, TREE_PART = 50, 35

# Common insults, second-person words, look-alike characters.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown dumb ugly "
                    "filthy vermin freak creep imbecile hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre "
                          "vos usted ustedes vosotros tus ti".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+[0-9@$!*]*[^\W\d_]*")
LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
CAPITAL = re.compile(r"[A-ZÀ-Þ]")
SHOUT = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
MARKS = re.compile(r"[!?]")
PUNCT = re.compile(r"[^\w\s]")

FEATURES = ("log_words", "insult_rate", "insult_count", "lexicon_rate", "lexicon_count", "lexicon_top", "near_you", "you_rate",
            "capital_rate", "shout_rate", "mark_rate", "punct_rate", "masked_rate", "masked_hits", "run_rate", "dense_window")


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to seven letters, under which the lexicon
    may list it."""
    return (word, *[word[:k] + "*" for k in range(4, min(8, len(word) + 1))])


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    weight: dict[str, float] = {}
    at, sums, top, insults, you = [], 0.0, 0.0, 0, []
    for k, w in enumerate(words):
        x = weight.get(w)
        if x is None:
            x = weight[w] = max([lexicon.get(t, 0.0) for t in terms_of(w)])
        if w in INSULTS:
            insults += 1
            at.append(k)
        elif x > 0:
            at.append(k)
        if x > 0:
            sums += x
            top = max(top, x)
        if w in SECOND_PERSON:
            you.append(k)
    near = 0
    if at and you:
        p = np.searchsorted(you, at)
        y = np.array([-10**9, *you, 10**9])
        a = np.array(at)
        near = int((np.minimum(a - y[p], y[p + 1] - a) <= 5).sum())
    dense = 0
    if at:
        a = np.array(at)
        dense = int((np.searchsorted(a, a + 50) - np.arange(len(a))).max())
    masked = MASKED.findall(text) if re.search(r"[0-9@$!*]", text) else []
    plain = [WORD.findall(m.lower().translate(LOOKALIKE)) for m in masked]
    hits = sum(any(w in INSULTS or any(t in lexicon for t in terms_of(w)) for w in ws) for ws in plain)
    chars = len(text)
    return [math.log1p(n), insults / n, float(insults), sums / n, float(len(at)), top, near / n, len(you) / n,
            len(CAPITAL.findall(text)) / chars, len(SHOUT.findall(text)) / n, len(MARKS.findall(text)) / n,
            len(PUNCT.findall(text)) / chars, len(masked) / n, float(hits), len(LONG_RUN.findall(text)) / n, float(dense)]


def sample_labels(labels: DataFrame, modulus: int, held: int, most: int) -> DataFrame:
    """Label rows outside the held-out fold, about ``most`` at the most, half of
    them toxic where there are so many, with a part number from 0 to 99."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(modulus) != held))
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    n_toxic = min(counts.get(1, 0), most // 2)
    share = {1: n_toxic / max(1, counts.get(1, 0)), 0: min(1.0, (most - n_toxic) / max(1, counts.get(0, 0)))}
    rows = rows.where(u < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    # rows kept by sampling stand for the others of their class in the calibration
    weight = F.when(F.col("toxic") == 1, F.lit(1 / max(share[1], 1e-9))).otherwise(F.lit(1 / max(share[0], 1e-9)))
    return rows.withColumn("weight", weight).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(100)))


def induce_lexicon(texts: DataFrame, most: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms that mark toxic rows (t, toxic), by log-likelihood ratio against
    chance over all terms tried, with their log odds; at most ``most`` terms."""
    def count(batches):
        from collections import Counter

        seen: list[Counter] = [Counter(), Counter()]

        def flush():
            keys = sorted(seen[0].keys() | seen[1].keys())
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()),
                                            pa.array([seen[1][k] for k in keys], pa.int64())], ["term", "c", "t"])
            seen[0].clear()
            seen[1].clear()
            return b

        for b in byte_portions(batches, "t"):
            for text, toxic in zip(b.column("t").to_pylist(), b.column("toxic").to_pylist()):
                seen[toxic].update({x for w in set(WORD.findall(text.lower())) for x in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    terms = texts.select("t", "toxic").mapInArrow(count, "term string, c long, t long").groupBy("term").agg(
        F.sum("c").alias("c"), F.sum("t").alias("t"))
    a, b = F.col("t").cast("double"), F.col("c").cast("double")
    rate = (a + b) / (n1 + n0)

    def ll(k, size, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(size - k > 0, (size - k) * F.log(1 - p)).otherwise(0.0)

    llr = 2 * (ll(a, n1, a / n1) + ll(b, n0, b / n0) - ll(a, n1, rate) - ll(b, n0, rate))
    odds = F.log((a + 0.1) / (n1 + 0.2)) - F.log((b + 0.1) / (n0 + 0.2))
    # a term that none but chance favours passes in less than one of all terms tried
    tried = terms.count()
    picked = terms.where(a / n1 > b / n0).withColumn("llr", llr).withColumn("odds", odds).where(
        (F.col("llr") > 2 * math.log(max(2, tried))) & (F.col("odds") > 1.5))
    return {r["term"]: r["odds"] for r in picked.orderBy(F.desc("llr"), "term").limit(most).collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    spark = docs.sparkSession
    picked = sample_labels(labels.select("doc_id", "toxic"), modulus, held, most)
    # bounded by the sample's bound: broadcast to the scan of the documents
    side = F.broadcast(picked.withColumnRenamed("doc_id", "_cx_id"))
    rows = docs.select("doc_id", text_of().alias("t")).join(side, F.col("doc_id") == F.col("_cx_id")).select("t", "toxic", "weight", "part")
    rows = stored(rows, "toxic-sample")
    lexicon = induce_lexicon(rows.where(F.col("part") < LEXICON_PART))
    shared = spark.sparkContext.broadcast(lexicon)  # at most LEXICON_TERMS entries

    def to_features(batches):
        lex = shared.value
        for b in byte_portions(batches, "t"):
            names = [c for c in b.schema.names if c != "t"]
            x = [features(t, lex) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    dense = rows.where(F.col("part") >= LEXICON_PART).mapInArrow(
        to_features, "toxic int, weight double, part long, x array<double>")
    dense = dense.select(F.col("toxic").cast("double").alias("label"), "weight", "part", array_to_vector("x").alias("features")).cache()
    trees = dense.where(F.col("part") < LEXICON_PART + TREE_PART)
    n = {r["label"]: r["count"] for r in trees.groupBy("label").count().collect()}
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(modulus) == held).alias("held_out"), text_of().alias("t"))
    if len(n) < 2:
        dense.unpersist()
        rate = rows.agg(F.sum(F.col("toxic") * F.col("weight")) / F.sum("weight")).first()[0] or 0.0
        scored = every.select("doc_id", "held_out", F.lit(float(rate)).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))

    model = GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.3, maxBins=64, seed=11, labelCol="label", featuresCol="features").fit(trees)
    margin = vector_to_array("rawPrediction").getItem(1)
    held_back = model.transform(dense.where(F.col("part") >= LEXICON_PART + TREE_PART)).select("label", "weight", margin.alias("margin"))
    iso = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held_back) if held_back.head(1) else None
    dense.unpersist()
    scored = every.mapInArrow(to_features, "doc_id long, held_out boolean, x array<double>").select(
        "doc_id", "held_out", array_to_vector("x").alias("features"))
    scored = model.transform(scored).select("doc_id", "held_out", margin.alias("margin"))
    raw = 1 / (1 + F.exp(-2 * F.col("margin")))
    if iso is not None:
        # the uncalibrated score keeps apart what the calibration's steps make equal
        scored = iso.transform(scored).withColumn("score", 0.99 * F.col("calibrated") + 0.01 * raw)
    else:
        scored = scored.withColumn("score", raw)
    return scored.select("doc_id", "held_out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
