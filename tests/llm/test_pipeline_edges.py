"""The whole pipeline over odd rows, an empty table and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose


def write(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(1, prose(77, 20)), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, odd, tmp_path):
    held = prose(78, 60) + " " + prose(77, 20)
    extra = odd.limit(1).select(*[F.lit(x).alias(c) if (x := {"doc_id": 900, "text": held, "source": "s1"}.get(c)) else c for c in odd.columns])
    docs = odd.unionByName(extra.withColumn("doc_id", F.col("doc_id").cast("long")))
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs))
    # an input column "shard" gives way to the pipeline's own
    assert set(got.columns) == set(docs.columns) | {"slot"}
    rows = got.collect()
    texts = {r["text"] for r in docs.collect()}
    assert {r["text"] for r in rows} <= texts and 900 not in {r["doc_id"] for r in rows}
    assert {1, 11, 12} & {r["doc_id"] for r in rows} and {r["size"] for r in rows} == {7}
    assert sorted((r["slot"], r["shard"]) for r in rows) == [(k // 8, k % 8) for k in range(len(rows))]


@pytest.mark.parametrize("wordless", [False, True])
def test_empty_tables(spark, none, odd, tmp_path, wordless):
    docs = odd.where("text IS NULL OR text = ''") if wordless else none
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs))
    assert got.count() == 0 and "slot" in got.columns
