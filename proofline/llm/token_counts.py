"""Token counts through a cache of content digests.

The digest of a text and the digest of the tokenizer file name a stored count.
Only distinct contents without a stored count are encoded; their counts are
appended to the cache. A null text counts as the empty text; an empty table gives
an empty result; repeated rows are encoded once and all keep their row; other
columns of the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, chunks, shared_dir, stage, texts_of
from .tokens import counter, file_digest

CACHE = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """Counts of the texts of ``misses`` (digest, text), each encoded once."""

    def count(batches):
        of = counter(path)
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in chunks(off, 1 << 21):
                n = of([raw[off[i] : off[i + 1]].tobytes().decode() for i in range(lo, hi)])
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    path: a tokenizer file, .json (tokenizers) or .model (sentencepiece).
    cache: a folder of stored counts, kept between runs; else one is made for this
    run. The normalisation is the one that no tokenizer can tell apart: null
    becomes empty, nothing else changes.
    """
    spark = docs.sparkSession
    version = file_digest(path)
    cache = cache or shared_dir(spark)
    content = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    stored = None
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_digest") == version).select(F.col("content_digest").alias("digest"), "n_tokens")
    misses = keyed.select("digest", "text")
    if stored is not None:
        misses = misses.join(stored, "digest", "left_anti")
    # One row a content leaves each map task, so a group of copies does not meet in one place.
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))
    encode_misses(distinct, path).select(F.col("digest").alias("content_digest"), F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    # Two runs at once may both append a content: the same count twice.
    stored = (
        spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_digest") == version)
        .groupBy(F.col("content_digest").alias("digest")).agg(F.first("n_tokens").alias("n_tokens"))
    )
    sizes = stage(docs.select("doc_id", F.octet_length(content).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest")), shared_dir(spark))
    return by_key(sizes, stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
