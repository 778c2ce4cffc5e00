"""Sharding of tables whose rows are mostly copies of one row."""

import collections

import pytest
from pyspark.sql import functions as F

from capstan.llm import sharding

from .conftest import prose

SCHEMA = "doc_id long, text string, source string, m map<string, int>"


def rows():
    hot = prose(1, 40)
    out = [(None, hot, "s", {"b": 2, "a": 1})] * 900 + [(1, hot, "s", None)] * 600 + [(2, None, None, None)] * 3
    return out + [(k, prose(100 + k, 30), f"s{k % 3}", {"k": k}) for k in range(500)]


@pytest.mark.parametrize("block", [sharding.BLOCK_COPIES, 7])
def test_copies_of_one_row_are_spread(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_COPIES", block)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    out = sharding.shuffled(docs)
    got = [r.asDict() for r in out.collect()]
    key = lambda r: (r["doc_id"], r["text"], r["source"], tuple(sorted((r["m"] or {"none": 0}).items())))
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert collections.Counter(map(key, got)) == collections.Counter(key(r.asDict()) for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # the hot row is everywhere, not in a few buckets' stretch of places
    places = [r["slot"] * 8 + r["shard"] for r in got if r["doc_id"] is None]
    assert all(sum(a <= p < a + 200 for p in places) > 40 for a in range(0, 2000, 200))
    again = sorted((str(key(r.asDict())), r["shard"], r["slot"]) for r in sharding.shuffled(docs.repartition(3)).collect())
    assert again == sorted((str(key(r)), r["shard"], r["slot"]) for r in got)


def test_no_bucket_holds_more_than_its_part(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    keyed = docs.withColumn("_cx_h", F.xxhash64("doc_id", "text"))
    hot = keyed.groupBy("_cx_h").count().where("count > 100").select("_cx_h")
    spread = sharding.spread(keyed, hot, docs.columns, 20)
    sizes = [r["n"] for r in spread.groupBy(F.pmod("_cx_h", F.lit(16)).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2003 and max(sizes) < 200


def test_tables_of_equal_rows_only(spark):
    docs = spark.createDataFrame([(None, None, None, None)] * 50, SCHEMA)
    got = sharding.shuffled(docs).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((k % 8, k // 8) for k in range(50))
