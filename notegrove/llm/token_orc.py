"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Stripes are read in parallel; a look-up by doc_id skips files and stripes by their minima and maxima, then row groups
by Bloom filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.llm import _tokenizer
from notegrove.llm._shared import session_folder

SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encoded(docs: DataFrame, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each row; null ids and count for a null text, none for an empty one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer.load(ranks)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                ids = [None if t is None else coder.encode_ordinary(t) for t in part.column("text").to_pylist()]
                counts = [None if x is None else len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "token_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, ranks: str = _tokenizer.DEFAULT_RANKS, options: dict[str, str] = OPTIONS) -> None:
    """One row for each row of docs, in order of doc_id within a file, so that minima and maxima tell row groups apart.

    Nothing is shuffled: a file holds what one scan task read. Null texts are written with null ids, empty ones with
    none; repeated rows and null doc_ids are written as they come. Other columns are not read. An empty table gives
    files without rows.
    """
    encoded(docs, ranks).sortWithinPartitions("doc_id").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of a written folder, or of some documents of it by indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))


def decoded(rows: DataFrame, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, text): the round trip back; null where the ids are null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer.load(ranks)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "token_ids").mapInArrow(decode, "doc_id long, text string")


def tokens_through_orc(docs: DataFrame, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """All rows written to a fresh folder of the shared folder and read from it again."""
    path = session_folder(docs.sparkSession, "tokens-orc")
    write_tokens(docs, path, ranks)
    return read_tokens(docs.sparkSession, path)
