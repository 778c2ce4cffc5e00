"""Quality rules at host level, in DataFrame functions only.

Every document is measured once; the measures of its host (``source``) are
pooled, the failure rates of hosts are shrunk with an empirical beta prior, and
the host's verdict is joined back to its documents.

Edge cases: a null text has no words and fails; null hosts form one host; equal
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, let, row_digest, sized, stored, text_of, split_words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Soft rules: symbols per word, repeated lines per line.
MAX_SYMBOL_SHARE = 0.3
MAX_DUP_LINE_SHARE = 0.5
#: A host is rejected as a whole from this shrunk failure rate on.
HOST_REJECT = 0.5
#: Documents that break a soft rule go if their host is not this clean.
HOST_TRUST = 0.02


def trigram_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in order."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                    lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def words_in_repeats(hashes: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    Texts without a repeated window are settled by one hash set; the others sort
    (hash, position) pairs and mark neighbours with equal hashes."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        marked = F.filter(
            F.transform(p, lambda x, k: F.when(
                (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, host, and the measures the rules use."""
    base = docs.select(
        F.col("doc_id"), F.col("source").alias("host"), row_digest(docs, "text", "source").alias("_cx_rk"),
        text_of().alias("_t"))
    base = base.select("doc_id", "host", "_cx_rk", "_t", split_words(F.col("_t"), SPACE).alias("_w"),
                       F.filter(F.split(F.col("_t"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    return base.select(
        "doc_id", "host", "_cx_rk",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        let(F.col("_w"), lambda w: let(trigram_hashes(w), words_in_repeats)).alias("n_repeat_words"))


def with_rules(measured: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    soft = ((F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("n_words"))
            | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines")))
    return measured.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_rates(ruled: DataFrame) -> DataFrame:
    """Failures by host and the rate shrunk by an empirical beta prior.

    The prior's mean is the pooled rate; its strength is fitted by moments over
    hosts: with rates r, sizes n and mean m, the variance beyond what binomial
    sampling explains sets alpha + beta = m (1 - m) / var - 1, held between 1
    and 1e6."""
    hosts = ruled.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(
        F.sum("failed").alias("f"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * rate * rate).alias("nr2")).select(
        (F.col("f") / F.col("t")).alias("m"),
        (F.col("nr2") / F.col("t") - (F.col("f") / F.col("t")) * (F.col("f") / F.col("t"))
         - (F.col("f") / F.col("t")) * (1 - F.col("f") / F.col("t")) * F.col("k") / F.col("t")).alias("v"))
    prior = prior.select("m", F.when(F.col("v") <= 0, F.lit(1e6)).otherwise(
        F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).alias("strength"))
    # the prior is one row: its broadcast has a fixed size
    return hosts.crossJoin(F.broadcast(prior)).select(
        F.col("host"), F.col("n").alias("host_docs"), F.col("failed").alias("host_failed"),
        ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("host_rate"))


def host_rules(docs: DataFrame) -> DataFrame:
    """Measures, rules, host rate and the verdict ``kept`` of every document."""
    ruled = with_rules(stored(measure(docs), "quality"))
    hosts = sized(stored(host_rates(ruled), "hosts"))
    hosts = hosts.withColumnRenamed("host", "_cx_host")
    out = ruled.join(hosts, F.col("host").eqNullSafe(F.col("_cx_host")), "left").drop("_cx_host")
    verdict = (F.col("host_rate") < HOST_REJECT) & ~(F.col("soft_failed") & (F.col("host_rate") >= HOST_TRUST))
    return out.withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the host rules keep, with their own columns."""
    bad = host_rules(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_cx_id"), "_cx_rk").distinct()
    return keep_rows(docs, stored(bad, "rejected"), "text", "source")
