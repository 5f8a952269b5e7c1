"""Token counts through a digest cache.

A text is normalised and digested; a cache table maps (content digest, tokenizer version) to a stored count. Only
distinct digests that the cache lacks are encoded, and what they give is appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.llm import _tokenizer
from notegrove.llm._shared import session_folder

CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


#: ASCII white space.
BLANKS = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    """Line ends as \\n, no ASCII white space at the end: what the counts are counts of."""
    return F.rtrim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(BLANKS))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; none where nothing has been stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str | None = None, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs.

    cache: folder of the cache table, a fresh one in the shared folder if None. It is appended to before this
    returns; two writers that miss the same digest both append it, which readers treat as one row. A null text has
    a null count, an empty one 0. Repeated rows and equal texts are encoded once and counted in each row; rows with
    a null doc_id are counted too. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache = cache or session_folder(spark, "token-cache")
    version = bytes.fromhex(_tokenizer.version(ranks))
    known = lambda: read_cache(spark, cache).filter(F.col("tokenizer") == F.lit(version))
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer.load(ranks)
        for batch in batches:
            counts = [len(coder.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.binary()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    misses = text.filter("text IS NOT NULL").select(digest, "text").join(known().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = known().groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return text.select("doc_id", digest).join(counts, "digest", "left").select("doc_id", "n_tokens")


def warm_counts(docs: DataFrame, **settings) -> DataFrame:
    """token_counts of rows that the cache knows all: one run fills a fresh cache, the second encodes nothing."""
    cache = session_folder(docs.sparkSession, "token-cache")
    token_counts(docs, cache, **settings)
    return token_counts(docs, cache, **settings)
