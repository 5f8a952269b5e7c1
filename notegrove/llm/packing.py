"""Online packing of documents into training windows by the sum-of-squares rule.

A window holds `capacity` tokens. Of all fill levels that have an open window a document fits in, and a new window,
the rule takes the one after which the sum over levels of the squared number of open windows is least. The numbers
stand in an array over levels, so a placement is one vector expression, whatever the number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm import _tokenizer
from notegrove.llm._shared import written

#: Tokens of a window, and tokens that one packer handles, about: 4,096 windows.
CAPACITY, SHARD_TOKENS = 2048, 1 << 23
SIZES = "doc_id long, n_tokens long"
PLACES = "shard int, window int, doc_id long, piece int, start long, n_tokens int, at int"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item, items in order of arrival, each of 1 to capacity tokens; number of windows.

    Of equally good levels the fullest is taken, and a new window only if it is better than all; of a level's
    windows the one that got there last.
    """
    windows, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for k, size in enumerate(sizes.tolist()):
        level = 0
        if size < capacity:
            # half the change of the sum of squares by going from level h to h + size, doubled to stay whole
            change = 2 * (count[size + 1 :] - count[1 : capacity + 1 - size]) + 2
            change[-1] = -2 * count[capacity - size] + 1
            change[count[1 : capacity + 1 - size] == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * count[size] + 1:
                level = best + 1
        if level:
            window = opened[level].pop()
            count[level] -= 1
        else:
            window, made = made, made + 1
        windows[k], offsets[k] = window, level
        if level + size < capacity:
            opened[level + size].append(window)
            count[level + size] += 1
    return windows, offsets, made


def token_sizes(docs: DataFrame, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens) of each row, an end-of-text token included; 0 for null and empty texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer.load(ranks)
        for batch in batches:
            counts = [len(coder.encode_ordinary(t)) + 1 if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, SIZES)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, ranks: str = _tokenizer.DEFAULT_RANKS) -> DataFrame:
    """Where each document's tokens go: (shard, window, doc_id, piece, start, n_tokens, at).

    Tokens start to start + n_tokens of the document lie at offset `at` of the window. A document longer than a
    window fills windows of its own and its rest is packed. Packers are independent: rows go to one by a hash of
    doc_id and size and arrive there in hash order, so the result does not depend on how the table is stored. Only
    sizes move between executors, never texts. Null and empty texts have nothing to pack and do not appear; rows
    with a null doc_id are packed with a null; repeated rows are packed each. Other columns are not read. An empty
    table gives an empty result.
    """
    sizes = written(token_sizes(docs, ranks).filter("n_tokens > 0"), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = -(-total // shard_tokens) or 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["turn", "doc_id", "n_tokens"], kind="stable")
        ids, size = frame["doc_id"].reset_index(drop=True), frame["n_tokens"].to_numpy()
        whole, rest = size // capacity, size % capacity
        row = np.repeat(np.arange(len(size)), whole)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        some = np.flatnonzero(rest)
        window, at, made = place(rest[some], capacity)
        full = pd.DataFrame({"window": made + np.arange(len(row)), "doc_id": ids.iloc[row].to_numpy(), "piece": piece, "start": piece * capacity, "n_tokens": capacity, "at": 0})
        tail = pd.DataFrame({"window": window, "doc_id": ids.iloc[some].to_numpy(), "piece": whole[some], "start": whole[some] * capacity, "n_tokens": rest[some], "at": at})
        out = pd.concat([tail, full], ignore_index=True)
        out.insert(0, "shard", int(frame["shard"].iloc[0]))
        return out.astype({"doc_id": "Int64"})

    turn = F.xxhash64("doc_id", "n_tokens")
    spread = sizes.withColumn("turn", turn).withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(run, PLACES)
