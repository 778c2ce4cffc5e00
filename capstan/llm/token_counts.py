"""Token counts through a digest cache.

A text's count depends on the tokenizer's version and on the text.  Counts are
kept in a table keyed by both digests; documents are joined to it, each distinct
text that is missing is encoded once, and its count is appended.

Edge cases: a null text counts as empty and has no tokens; equal texts are
encoded once, by the row with the least id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import byte_portions, sized, stored, text_of

#: With at most so many misses (a warm cache) their digests are broadcast and the
#: texts stay where they are; beyond it the texts are dealt by digest.
WARM_MISSES = 10_000

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def model_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_encoder(name: str):
    """Function from a list of texts to their token counts, for a ``.model``
    (sentencepiece) or ``.json`` (tokenizers) file."""
    path = model_path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(name: str) -> str:
    """Digest of the tokenizer file and the encoding library's version."""
    if name.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(model_path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib.__name__}|{lib.__version__}|plain".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row a digest."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
    # two jobs may have appended the same digest
    return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k.model", cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document.

    ``cache_path``: the cache table, in storage that all executors share; by
    default a new one in the checkpoint folder."""
    spark = docs.sparkSession
    cache_path = cache_path or f"{checkpoint_dir(spark).rstrip('/')}/llm-token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(name)
    digest = F.unhex(F.sha2(text_of().cast("binary"), 256))
    keyed = stored(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")

    known = read_cache(spark, cache_path, version)
    # min skips null ids; it is null only where a text has no other
    missing = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("_id")).join(known, "digest", "left_anti")
                     .withColumnRenamed("digest", "_digest"), "missing")
    todo = docs.select("doc_id", text_of().alias("t"), digest.alias("digest")).join(
        sized(missing, WARM_MISSES), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def encode(batches):
        count = load_encoder(name)
        for b in byte_portions(batches, "t"):
            texts, got = b.column("t").to_pylist(), []
            for k in range(0, len(texts), 64):
                got += count(texts[k:k + 64])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(got, pa.int64())], ["digest", "n_tokens"])

    fresh = todo.select("digest", "t").mapInArrow(encode, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
