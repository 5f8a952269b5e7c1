"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of all orders and a uniform one; the mixture depends on how
often the longest context occurs (buckets by powers of two), and its weights are learned by expectation-maximisation
on held-out documents against counts of the rest. Final scores use the counts of all documents less the occurrence
that is scored.

Documents are tokenised once into chunks of bounded size. A chunk counts its own distinct n-grams, cuts them by hash
into buckets and sends each bucket as one compressed block to be summed with the same bucket of other chunks; what
comes back is the sums in the block's own order, without keys, as the chunk can make its keys again. So texts and keys
never travel twice, a frequent n-gram costs one number a chunk, and no task gets more than FAN blocks at a time: with
more chunks than that, groups of chunks are summed first, then groups of groups, and sums return the same way. Counts
of single tokens are bounded by the vocabulary and go to every task. A context is an n-gram of the next lower order,
or one of the two contexts at a document's beginning, so contexts are not counted apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm import _tokenizer
from notegrove.llm._shared import mix, written

#: Longest n-gram; one document in so many is held out; tokens of a chunk, about, and events handled at once.
ORDER, HELD_ONE_IN, CHUNK_TOKENS, BLOCK = 3, 20, 2_500_000, 500_000
#: Blocks that one task sums at a time, and n-grams of a bucket, repeats in different chunks included: at most, about.
FAN, BUCKET_KEYS = 1024, 8_000_000
#: Buckets of context frequency; steps of a bit in which held-out estimates are tallied; rounds of EM.
BUCKETS, STEPS, ROUNDS = 40, 4, 60
CHUNKS = "chunk long, ids array<long>, sizes array<int>, held array<boolean>, tokens binary, held_tokens binary"
PARTS, SUMS = "src long, bucket long, keys binary, n binary, h binary", "src long, bucket long, n binary, kept binary"


def squeezed(array: np.ndarray, steps: bool = False, level: int = 1) -> bytes:
    """An array's bytes under zstandard; steps: differences, for sorted values."""
    return zstandard.ZstdCompressor(level=level).compress((np.diff(array, prepend=array.dtype.type(0)) if steps else array).tobytes())


def restored(packed: bytes, kind: type, steps: bool = False) -> np.ndarray:
    array = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)
    return np.cumsum(array, dtype=kind) if steps else array


def _split(docs: DataFrame, ranks: str, chunk_tokens: int, held_one_in: int) -> DataFrame:
    """Chunks of whole documents: ids, token numbers (-1 for a null text), which are held out, and all tokens end to end."""
    kind = np.uint16 if _tokenizer.size(ranks) < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = _tokenizer.load(ranks), 0
        ids, sizes, held, parts, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            every, out = (np.concatenate([np.zeros(0, kind), *some]) for some in (parts, itertools.compress(parts, held)))
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.bool_())), pa.array([squeezed(every, level=3)], pa.binary()), pa.array([squeezed(out, level=3)], pa.binary())],
                ["chunk", "ids", "sizes", "held", "tokens", "held_tokens"],
            )

        for batch in batches:
            for doc, text, out in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("held").to_pylist(), strict=True):
                text = text.as_py()
                own = np.array(coder.encode_ordinary(text or ""), kind)
                ids.append(doc)
                sizes.append(-1 if text is None else len(own))
                held.append(out)
                parts.append(own)
                total += len(own) + 1
                if total >= chunk_tokens:
                    yield row()
                    ids, sizes, held, parts, total, made = [], [], [], [], 0, made + 1
        if ids:
            yield row()

    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(held_one_in)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held")).mapInArrow(run, CHUNKS)


class Events:
    """Documents end to end as events: each token and the stop after the last. Contexts are filled up with stops at a document's beginning.

    Keys of n-grams are made for a range of events at a time; keys of different orders never meet.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, stop: int, order: int, block: int = BLOCK) -> None:
        self.width, self.order, self.block = stop.bit_length(), order, block
        if order * self.width > 58:
            raise ValueError("keys of this order don't fit 58 bits")
        sizes = np.maximum(sizes, 0).astype(np.int64)
        #: The document of each event, and the first event of each document.
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        real = np.ones(len(self.doc), bool)
        real[self.first + sizes] = False
        self.padded = np.full(int((sizes + order).sum()), stop, tokens.dtype if stop <= np.iinfo(tokens.dtype).max else np.uint32)
        self.padded[self.at(0, len(self.doc))[real]] = tokens

    def __len__(self) -> int:
        return len(self.doc)

    def at(self, start: int, end: int) -> np.ndarray:
        """Where events stand among the padded tokens."""
        return np.arange(start, end) + (self.order - 1) * (self.doc[start:end].astype(np.int64) + 1)

    def key(self, k: int, start: int, end: int) -> np.ndarray:
        """The n-gram of order k that each event of a range ends."""
        at, out = self.at(start, end), np.full(end - start, k << 58 >> (self.width * k), np.int64)
        for back in range(k - 1, -1, -1):
            out <<= self.width
            out |= self.padded[at - back]
        return out

    def ranges(self) -> Iterator[tuple[int, int]]:
        for start in range(0, len(self), self.block):
            yield start, min(start + self.block, len(self))

    def distinct(self, bits: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of orders 2 and up in order, how often each occurs, and their buckets; `which` events count, or all."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (start, end) in itertools.product(range(2, self.order + 1), self.ranges()):
            own = self.key(k, start, end)
            values, n = np.unique(own if which is None else own[which[start:end]], return_counts=True)
            keys.append(values)
            counts.append(n)
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        return values, np.bincount(at, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64), bucket_of(values, bits)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` bits of a hash: a bucket of few bits consists of whole ones of more bits."""
    return (mix(keys.view(np.uint64), 3) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _cut(keys: np.ndarray, n: np.ndarray, h: np.ndarray, bits: int) -> Iterator[tuple]:
    """(bucket, keys, n, h) blocks, the arrays compressed; keys of a bucket in order."""
    bucket = bucket_of(keys, bits)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]])) if len(keys) else []
    for start, end in itertools.pairwise(edges):
        own = order[start:end]
        yield int(bucket[own[0]]), squeezed(keys[own], True), squeezed(n[own]), squeezed(h[own])


def _merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some blocks, their sums of n and h; where each entry's key stands, block bounds, own h of each block."""
    keys, own_h = [restored(x, np.int64, True) for x in frame["keys"]], [restored(x, np.int64) for x in frame["h"]]
    n = np.concatenate([restored(x, np.int64) for x in frame["n"]]).astype(float)  # sums are whole up to 2^53
    values, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, weights=w, minlength=len(values)).astype(np.int64) for w in (n, np.concatenate(own_h).astype(float))]
    return values, *sums, at, np.cumsum([0, *map(len, keys)]), own_h


def _returned(frame: pd.DataFrame, n: np.ndarray, kept: np.ndarray, at: np.ndarray, bounds: np.ndarray, own_h: list[np.ndarray], leaf: bool) -> pd.DataFrame:
    """For each block the sums of its keys; `kept` of a chunk (leaf) only those of keys that its held-out documents have."""
    parts = [at[a:b] for a, b in itertools.pairwise(bounds)]
    back = [squeezed(kept[p[h > 0] if leaf else p]) for p, h in zip(parts, own_h, strict=True)]
    return pd.DataFrame({"src": frame["src"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "n": [squeezed(n[p]) for p in parts], "kept": back})


def sums(parts: DataFrame, sources: int, keys_each: int, fan: int = FAN, bucket_keys: int = BUCKET_KEYS, leaf: bool = True) -> DataFrame:
    """(src, bucket, n, kept) for the blocks (PARTS) of `sources` sources with keys_each keys at most: sums over all of them.

    kept is n less h. With more sources than `fan`, groups of them are merged and summed as sources in their turn.
    """
    if sources <= fan:

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            _, n, h, *rest = _merged(frame)
            return _returned(frame, n, n - h, *rest, leaf)

        return parts.groupBy("bucket").applyInPandas(total, SUMS)
    groups = -(-sources // fan)
    bits, finer = bits_for(sources, keys_each, fan, bucket_keys), bits_for(groups, keys_each * fan, fan, bucket_keys)
    parts = written(parts.withColumn("grp", F.pmod(F.xxhash64("src"), F.lit(groups))), "blocks")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        values, n, h, *_ = _merged(frame)
        return pd.DataFrame([(frame["grp"].iloc[0], *block) for block in _cut(values, n, h, finer)], columns=["src", "bucket", "keys", "n", "h"])

    above = written(parts.groupBy("grp", "bucket").applyInPandas(merge, PARTS), "blocks")
    found = above.select("src", "bucket", "keys").join(sums(above, groups, keys_each * fan, fan, bucket_keys, False), ["src", "bucket"])
    found = found.select(F.col("src").alias("grp"), F.shiftright("bucket", finer - bits).alias("bucket"), "keys", "n", "kept")

    def spread(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        values, _, _, *rest = _merged(own)
        keys = np.concatenate([restored(x, np.int64, True) for x in told["keys"]])
        order = np.argsort(keys)
        if not np.array_equal(keys[order], values):
            raise ValueError("sums of other n-grams came back")
        n, kept = (np.concatenate([restored(x, np.int64) for x in told[c]])[order] for c in ("n", "kept"))
        return _returned(own, n, kept, *rest, leaf)

    return parts.groupBy("grp", "bucket").cogroup(found.groupBy("grp", "bucket")).applyInPandas(spread, SUMS)


def bits_for(sources: int, keys_each: int, fan: int, bucket_keys: int) -> int:
    """log2 of the buckets that keep what one task sums below bucket_keys, about."""
    return min(40, (min(sources, fan) * keys_each // bucket_keys).bit_length())


def _estimates(events: Events, start: int, end: int, keys: np.ndarray, counts: np.ndarray, single: np.ndarray, less: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a range of events: bucket of each, and its maximum-likelihood estimates by order. `less` is taken off every count.

    counts: of the keys of orders 2 and up; single: of single tokens, the stop last, which occurs once a document.
    """
    before = max(0, start - 1)  # a context is the n-gram that the event before ends
    opens = np.zeros(end - start, bool)
    opens[events.first[np.searchsorted(events.first, start) : np.searchsorted(events.first, end)] - start] = True
    context, out = np.full(end - start, single.sum()), []
    for k in range(1, events.order + 1):
        if k == 1:
            every = single[events.padded[events.at(before, end)]]
        else:
            values, at = np.unique(events.key(k, before, end), return_inverse=True)
            every = counts[np.searchsorted(keys, values)][at]
        own, below = np.maximum(0, every[start - before :] - less), np.maximum(0, context - less)
        out.append(np.where(below > 0, own / np.maximum(below, 1), 0.0))
        context = np.where(opens, single[-1], np.concatenate([every[:1], every])[: end - start] if before == start else every[: end - start])
    return np.minimum(np.log2(below + 1).astype(np.int32), BUCKETS - 1), out


def learn(cells: pd.DataFrame, order: int, stop: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket and order from tallied held-out events; equal ones for a bucket without any."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    if len(cells) == 0:
        return weights
    levels = np.stack([np.full(len(cells), 1 / (stop + 1))] + [np.where(cells[f"q{k}"] < 0, 0, 2.0 ** (-cells[f"q{k}"] / STEPS)) for k in range(1, order + 1)], 1)
    bucket, n = cells["bucket"].to_numpy(), cells["n"].to_numpy(float)
    for _ in range(rounds):
        share = levels * weights[bucket]
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        totals = np.zeros_like(weights)
        for k in range(order + 1):
            totals[:, k] = np.bincount(bucket, weights=share[:, k], minlength=BUCKETS)
        some = totals.sum(1) > 0
        weights[some] = totals[some] / totals[some].sum(1, keepdims=True)
    return np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum(1, keepdims=True)


def lm_scores(docs: DataFrame, order: int = ORDER, ranks: str = _tokenizer.DEFAULT_RANKS, chunk_tokens: int = CHUNK_TOKENS, held_one_in: int = HELD_ONE_IN, fan: int = FAN, bucket_keys: int = BUCKET_KEYS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, log2_prob, bits_per_token) of each row of docs under the model of all of them.

    bits_per_token is -log2_prob over n_tokens + 1, the end of the text counted. An empty text has no token but an
    end; a null text counts for nothing and has nulls. Repeated rows are counted and scored each; a null doc_id
    stays null. Other columns are not read. An empty table gives an empty result.
    """
    stop = _tokenizer.size(ranks)
    kind = np.uint16 if stop < 1 << 16 else np.uint32
    chunks = written(_split(docs, ranks, chunk_tokens, held_one_in), "chunks")
    sources, keys_each = chunks.count(), (order - 1) * chunk_tokens
    bits = bits_for(sources, keys_each, fan, bucket_keys)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Chunks one at a time, their lists as arrays and their bytes as they came."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                row = {name: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() if name == "chunk" else v for name, v in row.items()}
                row["sizes"] = row["sizes"].values.to_numpy()
                row["held"] = row["held"].values.to_numpy(zero_copy_only=False)
                yield row

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, stop + 1), np.int64)
        for row in rows_of(batches):
            some = row["sizes"] >= 0
            for k, (name, texts) in enumerate((("tokens", some), ("held_tokens", some & row["held"]))):
                n[k] += np.bincount(restored(row[name], kind), minlength=stop + 1)
                n[k, stop] += texts.sum()
        which = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(n[0, which]), pa.array(n[1, which])], ["token", "n", "h"])

    counted = chunks.select("sizes", "held", "tokens", "held_tokens").mapInArrow(singles, "token int, n long, h long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).toPandas()
    single = np.zeros((2, stop + 1), np.int64)  # as long as the vocabulary, whatever the corpus
    single[0, counted["token"]], single[1, counted["token"]] = counted["n"], counted["n"] - counted["h"]
    shared = docs.sparkSession.sparkContext.broadcast(single)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            some = row["sizes"] >= 0
            events = Events(restored(row["tokens"], kind), row["sizes"][some], stop, order, block)
            keys, n, _ = events.distinct(bits)
            held, own, _ = events.distinct(bits, row["held"][some][events.doc])
            h = np.zeros(len(keys), np.int64)
            h[np.searchsorted(keys, held)] = own
            blocks = list(_cut(keys, n, h, bits))
            for part in (blocks[at : at + 64] for at in range(0, len(blocks), 64)):
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(part), pa.int64()), *map(pa.array, zip(*part, strict=True))], ["src", "bucket", "keys", "n", "h"])

    parts = chunks.select("chunk", "sizes", "held", "tokens").mapInArrow(tell, PARTS)
    known = written(sums(parts, sources, keys_each, fan, bucket_keys), "sums")
    by_chunk = lambda c: known.select(F.col("src").alias("chunk"), "bucket", c).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", c))).alias("sums"))

    def counts_of(row: dict, events: Events, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a chunk and the sums that came back for them."""
        keys, _, bucket = events.distinct(bits)
        came = row["sums"].values
        told = np.concatenate([np.zeros(0, np.int64), *(restored(x.as_buffer(), np.int64) for x in (came.field(name) if came is not None else ()))])
        out = np.zeros(len(keys), np.int64)
        out[np.argsort(bucket, kind="stable")] = told
        return keys, out

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            some = row["held"] & (row["sizes"] >= 0)
            if some.any():
                events = Events(restored(row["held_tokens"], kind), row["sizes"][some], stop, order, block)
                known = counts_of(row, events, "kept")
                for start, end in events.ranges():
                    bucket, levels = _estimates(events, start, end, *known, shared.value[1], 0)
                    steps = [np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-30)) * STEPS), -1).astype(np.int32) for p in levels]
                    cells = pd.DataFrame({"bucket": bucket, **{f"q{k}": p for k, p in enumerate(steps, 1)}})
                    yield pa.RecordBatch.from_pandas(cells.groupby(list(cells.columns)).size().reset_index(name="n"), preserve_index=False)

    names = ["bucket", *(f"q{k}" for k in range(1, order + 1))]
    joined = chunks.select("chunk", "sizes", "held", "held_tokens").join(by_chunk("kept"), "chunk", "left")
    cells = joined.mapInArrow(tally, ", ".join(f"{c} int" for c in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        return pd.DataFrame({"bucket": bucket, "level": np.arange(order + 1), "w": learn(frame, order, stop)[bucket]})

    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    for bucket, level, w in cells.groupBy("bucket").applyInPandas(learned, "bucket int, level int, w double").collect():  # buckets times levels
        weights[bucket, level] = w

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            some = row["sizes"] >= 0
            events, found = Events(restored(row["tokens"], kind), row["sizes"][some], stop, order, block), np.zeros(len(some))
            known, own = counts_of(row, events, "n"), np.zeros(int(some.sum()))
            for start, end in events.ranges():
                bucket, levels = _estimates(events, start, end, *known, shared.value[0], 1)
                mixed = (weights[:, 0] / (stop + 1))[bucket]
                for k, p in enumerate(levels, 1):
                    mixed += p * weights[bucket, k]
                own += np.bincount(events.doc[start:end], weights=np.log2(mixed), minlength=len(own))
            found[some] = own
            yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(row["sizes"].astype(np.int64), mask=~some), pa.array(found, mask=~some)], ["doc_id", "n_tokens", "log2_prob"])

    # a chunk without n-grams of order 2 (one of null texts alone) has no sums
    whole = chunks.select("chunk", "ids", "sizes", "held", "tokens").join(by_chunk("n"), "chunk", "left")
    scored = whole.mapInArrow(score, "doc_id long, n_tokens long, log2_prob double")
    return scored.select("doc_id", "n_tokens", "log2_prob", (-F.col("log2_prob") / (F.col("n_tokens") + 1)).alias("bits_per_token"))
