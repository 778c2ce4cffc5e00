import collections
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from capstan.llm import language, quality, queries, sharding, toxicity
from capstan.llm.common import table

from .conftest import prose

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_shards_are_even_gapless_and_repeatable(odd, odd_rows, none):
    out = sharding.shuffled(odd)
    rows = out.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter((r[0], r[1]) for r in odd_rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(8)]
    assert sum(counts) == len(odd_rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:50], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, sharding.shuffled(odd.repartition(5)).collect()))
    assert sharding.shuffled(none).count() == 0
    assert set(odd.columns) | {"slot"} == set(out.columns)


def test_fisher_yates_orders_are_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(s, 0, 3)) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert list(sharding.fisher_yates(1, 2, 50)) == list(sharding.fisher_yates(1, 2, 50)) != list(range(50))


def test_written_shards_hold_every_record(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 5)) for k in range(101)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 4 and {r["doc_id"] for r in back.collect()} == set(range(101))


def test_offsets_are_running_counts(spark):
    r = random.Random(1)
    b = [r.randrange(5000) for _ in range(9000)]
    got = {x["_cx_b"]: x["_cx_off"] for x in sharding.bucket_offsets(spark.createDataFrame([(x,) for x in b], "_cx_b long"), 64).collect()}
    c, run = collections.Counter(b), 0
    for k in sorted(c):
        assert got[k] == run
        run += c[k]


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF01, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert {r["doc_id"] for r in rows} == set(lang) and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert np.mean([r["rejected"] for r in held]) < 0.1 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_never_reads_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs = table(spark, SF01, "documents").limit(300)
    wrong = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "xx").otherwise(F.col("lang")))
    assert "xx" not in {r["lang_pred"] for r in language.identify(wrong).collect()}


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows) and language.identify(none).count() == 0
    pred = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert pred[2] == pred[3] == pred[8] == pred[9] == pred[15] == "und" and pred[1] != "und"
    blank = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(blank).collect()] == [("und", 0.0)]


def test_gradient_step_lowers_the_loss():
    r = np.random.default_rng(0)
    bags, y = [], []
    for k in range(80):
        c = k % 2
        at = np.unique(r.integers(0, 500, 40) * 2 + c)
        bags.append((at, np.full(len(at), 1 / len(at))))
        y.append(c)
    emb, layer = language.train(bags, np.array(y), 2)
    assert np.mean([(s @ emb[a] @ layer).argmax() == c for (a, s), c in zip(bags, y)]) == 1


def test_toxic_documents_rank_first(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [i for i in y if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (fold(i, 3) == 1) for i in rows) and len(rows) == docs.count()
    pos, neg = [rows[i]["score"] for i in held if y[i]], [rows[i]["score"] for i in held if not y[i]]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.75 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == len(odd_rows)
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_features_see_masked_and_near_words():
    x = dict(zip(toxicity.FEATURES, toxicity.features("You are an IDIOT! such an id10t, st*pid idiot you", {"lous*": 2.0})))
    assert x["insult_count"] == 2 and x["near_you"] > 0 and x["masked_hits"] >= 1 and x["shout_rate"] > 0 and x["mark_rate"] > 0
    y = dict(zip(toxicity.FEATURES, toxicity.features("the lousy day", {"lous*": 2.0})))
    assert y["lexicon_top"] == 2.0 and toxicity.features("", {}) == [0.0] * len(toxicity.FEATURES)


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_against_brute_force(spark):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    docs = table(spark, SF001, "documents")
    stages = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(stage(spark, stages[-1], SF001).cache())
    assert all(s.columns == docs.columns for s in stages[1:-1])
    text = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages]
    kept = {r["doc_id"] for r in quality.host_rules(docs).where("kept").collect()}
    assert set(text[1]) == kept
    sets = {i: grams(t) for i, t in text[1].items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(text[2]) == {find(i) for i in sets}
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in table(spark, SF001, "benchmark").collect()]
    whole = {i for i, t in text[2].items() if any(" ".join(w) in " ".join(re.findall(r"[^\W_]+", t.lower())) for w in items)}
    assert whole and not whole & set(text[3]) and len(text[2]) - len(text[3]) <= len(whole) + 3
    assert set(text[4]) <= set(text[3])
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        sizes[r["source"]] += len(r["text"].split())
    for r in stages[4].collect():
        taken[r["source"]] += len(r["text"].split())
    assert sum(sizes.values()) < sum(taken.values()) < 2 * sum(sizes.values())
    last = stages[5].collect()
    assert collections.Counter(r["doc_id"] for r in last) == collections.Counter(r["doc_id"] for r in stages[4].collect())
    assert {r["shard"] for r in last} == set(range(8))


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert names[-1] == "pipeline" and [int(n[2:].split("_")[0]) for n in names[:-1]] == list(range(1, 11))
