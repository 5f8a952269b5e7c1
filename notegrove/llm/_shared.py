"""Helpers that several operators share: word hashing, SimHash sums and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of lower-cased UTF-8 that words consist of: ASCII letters, digits, the underscore, and whatever isn't ASCII.
WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_IN_WORD = np.array([bool(WORD.fullmatch(bytes([b]))) for b in range(256)])
_VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that are hashed at one go, about; a longer text goes by itself.
GO = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def _up_to(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: see WORD."""
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def _hash_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and where it begins. Polynomial hashes of all words at once, from running sums."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return hashes & ~np.uint64(31) | np.minimum(end - start, 31).astype(np.uint64), start


def hash_texts(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and len(texts)+1 offsets of the texts in them.

    The low five bits of a hash are the word's length in bytes, 31 for longer ones.
    """
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held: list[bytes] = []

    def go() -> None:
        hashes, start = _hash_bytes(b"\n".join(held))
        bounds = np.cumsum([0, *(len(t) + 1 for t in held)])
        counts.append(np.diff(np.searchsorted(start, bounds)))
        parts.append(hashes)
        held.clear()

    size = 0
    for text in texts:
        held.append((text or "").lower().encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= GO:
            go()
            size = 0
    if held:
        go()
    every = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(every)]).astype(np.int64)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values; another function for each seed."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, one for each place where a run begins."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out = words[:n] * odd
        for k in range(1, size):
            out = (out ^ out >> np.uint64(29)) * odd + words[k : n + k]
    return out ^ out >> np.uint64(32)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, 0 or 1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 truth values as signed 64-bit fingerprints."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def session_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    A temporary folder of this machine serves only where the session names none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if base is None:
            base = tempfile.mkdtemp(prefix="notegrove-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cut lineage that outlives executors."""
    path = session_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, wish: str) -> str:
    """`wish`, with underscores appended until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: log2 of the bits that tell rows apart before a join: at least, at most (32 MB); bits for each id, about.
SIEVE_BITS, BITS_PER_ID = (20, 28), 32


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among the one column of ids; those with a null doc_id stay.

    Rows whose hash no id has, found by a bit map of bounded size that goes to every task, stay where they are; only
    the others are joined and may be shuffled. The more ids, the fuller the map: it never decides that a row goes.
    """
    named = written(ids.toDF("id").select(F.col("id").cast("long")).filter("id IS NOT NULL").distinct(), "ids")
    n = named.count()
    if n == 0:
        return docs
    bits = min(max((BITS_PER_ID * n).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits)) + 1
    part, sieve, key = fresh_name(docs, "part"), fresh_name(docs, "sieve"), fresh_name(docs, "key")
    maps = named.groupBy(F.bitmap_bucket_number(slot(F.col("id"))).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(F.col("id")))).alias(sieve))
    doc_id = F.col("doc_id")
    at = F.bitmap_bit_position(slot(doc_id))
    byte = F.conv(F.hex(F.substring(F.col(sieve), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    own = F.when(doc_id.isNotNull(), F.bitmap_bucket_number(slot(doc_id)))
    marked = docs.join(F.broadcast(maps), own == F.col(part), "left")
    rest = marked.filter(maybe).drop(part, sieve).join(named.withColumnRenamed("id", key), doc_id.cast("long") == F.col(key), "left_anti")
    return marked.filter(~maybe).drop(part, sieve).unionByName(rest)
