"""Quality rules by compression: how well zstandard shrinks a whole text and its fixed chunks.

Repeated lines and copied blocks shrink to almost nothing; random strings, hashes and encoded binaries hardly
shrink. Natural prose lies between, in a band that narrows as texts get longer, so the limits depend on length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm._shared import fresh_name

#: (bytes from which the band holds, least ratio, greatest ratio) for whole texts. Below 96 bytes no text shrinks enough to tell prose from random strings.
BANDS = ((0, 0.0, 9.0), (16, 0.9, 1.6), (32, 0.65, 1.3), (64, 0.45, 1.15), (96, 0.40, 1.02), (128, 0.36, 0.93), (192, 0.34, 0.86), (256, 0.32, 0.79), (512, 0.30, 0.74), (1024, 0.28, 0.70), (2048, 0.26, 0.66), (4096, 0.25, 0.64), (16384, 0.22, 0.62))
#: Bytes of a chunk, the band of full chunks, and the share of a text's bytes in chunks outside their band from which it is rejected.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.28, 0.64), 0.25
LEVEL = 3
SCHEMA = "n_bytes long, ratio double, n_chunks int, bad_chunks int, keep boolean"


def judge(text: str | None, packer: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, chunk_band: tuple = CHUNK_BAND, share: float = CHUNK_SHARE) -> tuple:
    """(n_bytes, ratio, n_chunks, bad_chunks, keep); nulls but for keep = False where the text is null or empty.

    Every byte is in a chunk: the last one is as long as what is left, and its band is that of texts of its length.
    """
    if not text:
        return None if text is None else 0, None, 0, 0, False
    raw = text.encode("utf-8", "surrogatepass")
    n, starts = len(raw), [b[0] for b in bands]
    ratio = len(packer.compress(raw)) / n
    band = lambda size: bands[bisect.bisect_right(starts, size) - 1][1:]
    bad = lost = 0
    for at in range(0, n, chunk):
        part = raw[at : at + chunk]
        least, most = chunk_band if len(part) == chunk else band(len(part))
        if not least <= (ratio if len(part) == n else len(packer.compress(part)) / len(part)) <= most:
            bad, lost = bad + 1, lost + len(part)
    least, most = band(n)
    return n, ratio, -(-n // chunk), bad, least <= ratio <= most and lost < share * n


def verdicts(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK, chunk_band: tuple = CHUNK_BAND, share: float = CHUNK_SHARE) -> DataFrame:
    """docs with one more column `rule` (struct n_bytes, ratio, n_chunks, bad_chunks, keep), or `rule_` where taken.

    One pass without a shuffle. A null or empty text is rejected: its ratio is null. Each row is judged by itself,
    so ties, repeated rows and other columns make no difference, and an empty table stays empty.
    """

    @F.pandas_udf(SCHEMA)
    def rule(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for texts in batches:
            yield pd.DataFrame([judge(t, packer, bands, chunk, chunk_band, share) for t in texts], columns=["n_bytes", "ratio", "n_chunks", "bad_chunks", "keep"]).astype({"n_bytes": "Int64"})

    return docs.withColumn(fresh_name(docs, "rule"), rule(F.col("text")))


def compression_report(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_bytes, ratio, n_chunks, bad_chunks, keep) for every row; see verdicts."""
    return verdicts(docs.select("doc_id", "text"), **limits).select("doc_id", "rule.*")


def keep_by_compression(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules keep, with the columns they had; see verdicts."""
    name = fresh_name(docs, "rule")
    return verdicts(docs, **limits).filter(F.col(f"{name}.keep")).drop(name)
