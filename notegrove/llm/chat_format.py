"""Chat formatting at token level.

Role headers and contents are encoded separately, reserved ids are spliced between them, and the loss mask comes from
prefix sums over segment bounds. Ids of the vocabulary can never be reserved ids, and control strings that occur in
contents are escaped as well, so that decoded text cannot be mistaken for structure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm import _tokenizer

#: Reserved ids count from the vocabulary's size, in this order.
RESERVED = ("<|begin|>", "<|turn|>", "<|content|>", "<|end_turn|>", "<|end|>")
#: Roles whose contents and closing ids are trained on.
TRAINED = ("assistant",)
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
SCHEMA = "conv_id long, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    """Puts a backslash into whatever could open a control string; unescape undoes it."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def assemble(turns: list[tuple[str | None, str | None]], ranks: str = _tokenizer.DEFAULT_RANKS, trained: tuple = TRAINED) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a conversation, given its (role, text) in order; a null role is 'unknown', a null text empty."""
    coder, base = _tokenizer.load(ranks), _tokenizer.size(ranks)
    begin, turn, content, end_turn, end = ([base + k] for k in range(len(RESERVED)))
    parts, flags = [begin], [0]
    for role, text in turns:
        parts += [turn, coder.encode_ordinary(escape(role or "unknown")), content, coder.encode_ordinary(escape(text or "")), end_turn]
        flags += [0, 0, 0, *[int(role in trained)] * 2]
    parts.append(end)
    flags.append(0)
    ends = np.cumsum([len(p) for p in parts])
    starts, on = ends - np.array([len(p) for p in parts]), np.array(flags, bool)
    steps = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(steps, starts[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.fromiter((i for p in parts for i in p), np.int32, ends[-1]), np.cumsum(steps[:-1]).astype(np.int8)


def format_conversations(turns: DataFrame, ranks: str = _tokenizer.DEFAULT_RANKS, trained: tuple = TRAINED) -> DataFrame:
    """One row a conv_id: (conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask).

    Turns stand in order of turn, then role, then text, nulls first; a repeated row is a repeated turn. Rows with a
    null conv_id are left out. Null texts and roles: see assemble. Texts are encoded whole, however long. Other
    columns are not read. An empty table gives an empty result.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                said = part.column("turns").to_pylist()
                made = [assemble([(t["role"], t["text"]) for t in c], ranks, trained) for c in said]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in made])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[k] for m in made]))) for k in (0, 1)] if made else [pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([len(c) for c in said], pa.int32()), pa.array([len(i) for i, _ in made], pa.int32()), pa.array([int(m.sum()) for _, m in made], pa.int32()), *lists],
                    ["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"],
                )

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").filter("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).mapInArrow(build, SCHEMA)
