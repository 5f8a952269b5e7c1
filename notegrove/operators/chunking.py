"""Line-aligned chunks with overlap.

Which lines a chunk takes depends on where the one before ended, so a text is walked from front to back; over running
sums of line sizes each step is one binary search. Rows go to Python in Arrow batches and come back in smaller ones, so
that what a task holds doesn't grow with its table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrove.config import ChunkingConfig

#: Characters of chunks that a task holds before it passes them on.
BATCH_CHARS = 4_000_000


def split_text(text: str, config: ChunkingConfig) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each chunk; lines count from 1, an empty text is one empty chunk."""
    most, overlap = config.max_chars, config.overlap_chars
    pieces = [(number, line[at : at + most]) for number, line in enumerate(text.split("\n"), 1) for at in range(0, len(line) or 1, most)]
    sums = [0, *accumulate(len(piece) + 1 for _, piece in pieces)]
    out, start, fresh = [], 0, 0
    while True:
        # at least one piece that the chunk before lacked, and as many as fit
        stop = max(fresh + 1, bisect_right(sums, sums[start] + most) - 1)
        out.append((pieces[start][0], pieces[stop - 1][0], "\n".join(p for _, p in pieces[start:stop])))
        if stop == len(pieces):
            return out
        start = max(start, bisect_right(sums, sums[stop] - overlap) - 1) if overlap else stop
        fresh = stop


def chunk_texts(texts: DataFrame, config: ChunkingConfig | None = None) -> DataFrame:
    """Every column but `text`, then chunk_no, start_line, end_line and text: a row for each chunk of each text. Null texts have none."""
    config = config or ChunkingConfig()
    rest = [c for c in texts.columns if c != "text"]
    made = [T.StructField("chunk_no", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows, chars = batch.column(len(rest)), [], 0

            def passed(rows, batch=batch, column=column) -> pa.RecordBatch:
                at, *parts = zip(*rows, strict=True)
                kinds = pa.int32(), pa.int32(), pa.int32(), column.type
                kept = [batch.column(k).take(pa.array(at)) for k in range(len(rest))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True))], [*rest, *(f.name for f in made)])

            for at in range(batch.num_rows):
                text = column[at].as_py()
                for number, chunk in enumerate(split_text(text, config) if text is not None else ()):
                    rows.append((at, number, *chunk))
                    chars += len(chunk[2])
                    if chars >= BATCH_CHARS:
                        yield passed(rows)
                        rows, chars = [], 0
            if rows:
                yield passed(rows)

    whole = texts.select(*(F.col(f"`{c}`") for c in (*rest, "text")))
    return whole.mapInArrow(run, T.StructType([*whole.schema.fields[:-1], *made]))
