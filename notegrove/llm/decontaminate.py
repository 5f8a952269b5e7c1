"""Benchmark decontamination by SimHash over item-sized windows.

A document is contaminated by a benchmark item when one of its windows, as many words long as the item, has a SimHash
within `radius` bits of the item's and a weighted-shingle similarity of at least `least`. A shingle is two words,
its weight is their length in bytes (a word of more than 31 counts 31, so that no single string decides), and the similarity is the weighted Jaccard of the two multisets.

1. Screening. Overlap with an item is at most the weight of the window's shingles that some item of that length
   holds, and the union is at least what follows from the window's and the lightest item's weights: windows in which
   those shingles make up too little cannot pass, so leaving them out loses nothing. The items' shingles stand in a bit map of bounded size.
2. Multi-index Hamming search. Fingerprints within `radius` agree within radius // 4 in one of four 16-bit blocks;
   items are listed under every value that near to each of their blocks, windows look their four blocks up.
3. Verification of each candidate by the exact similarity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrove.llm._shared import bits_of, hash_texts, mix, pack_bits, shingle_hashes, without, written

RADIUS, LEAST = 15, 0.6
#: Items of fewer words say too little to tell a near leak from chance: they count only word by word.
MIN_WORDS = 8
#: log2 of the bits of the screening map: at least, at most (32 MB); slots for each entry, about.
MAP_BITS, SLOTS_PER_ENTRY = (20, 28), 64
FAR = 1 << 40


def weigh(words: np.ndarray) -> np.ndarray:
    """Hash of each shingle; its low six bits are the shingle's weight. A single word is its own shingle."""
    length = words & np.uint64(31)
    if len(words) == 1:
        return words & ~np.uint64(63) | length
    return shingle_hashes(words, 2) & ~np.uint64(63) | length[:-1] + length[1:]


def weights_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(63)).astype(np.int64)


def fingerprints(shingles: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of each window of shingles, repeated ones as often as they occur, as signed numbers."""
    votes = (2 * bits_of(mix(shingles, 5)).astype(np.int32) - 1) * weights_of(shingles)[:, None].astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(votes, axis=0, dtype=np.int64)])
    return pack_bits(sums[end] - sums[start] > 0)


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    values, at = np.unique(np.concatenate([left, right]).view(np.uint64), return_inverse=True)
    a, b = np.bincount(at[: len(left)], minlength=len(values)), np.bincount(at[len(left) :], minlength=len(values))
    weight = weights_of(values)
    return float((np.minimum(a, b) * weight).sum() / max(1, (np.maximum(a, b) * weight).sum()))


def _salt(size: int, bits: int) -> int:
    return int(mix(np.array([size], np.uint64), 77)[0]) & ((1 << bits) - 1)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, weight, fp, shingles) of the items that have words; size is their number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat, offsets = hash_texts(frame["text"])
            rows = []
            for k, item in enumerate(frame["item_id"]):
                words = flat[offsets[k] : offsets[k + 1]]
                if len(words):
                    shingles = weigh(words)
                    fp = fingerprints(shingles, np.array([0]), np.array([len(shingles)]))[0]
                    rows.append((item, len(words), weights_of(shingles).sum(), fp, shingles.view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "size", "weight", "fp", "shingles"])

    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInPandas(run, "item_id long, size int, weight long, fp long, shingles array<long>")


def _slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(6) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _screen(items: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """The bit map as truth values, and each window size with the least weight of its items. Two entries for each item's shingle: of any size, of its own."""
    sizes = dict(sorted(items.groupBy("size").agg(F.min("weight")).collect()))
    entries = items.agg(F.sum(2 * F.size("shingles"))).first()[0] or 0
    bits = min(max(MAP_BITS[0], (entries * SLOTS_PER_ENTRY).bit_length()), MAP_BITS[1])

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, shingles in zip(frame["size"], frame["shingles"], strict=True):
                slot = _slots(np.asarray(shingles, np.int64), bits)
                yield pd.DataFrame({"slot": np.concatenate([slot, slot ^ _salt(size, bits)]) + 1})

    parts = items.select("size", "shingles").mapInPandas(slots, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    screen = np.zeros(1 << bits, bool)
    for number, chunk in parts.collect():
        screen[(number - 1) << 15 : number << 15] = np.unpackbits(np.frombuffer(chunk, np.uint8), bitorder="little")
    return screen, sizes


def promising(any_hit: np.ndarray, weights: np.ndarray, sizes: dict[int, int], least: float) -> np.ndarray:
    """The shingles with which a window could begin whose hits make up `least` of its weight, whatever its size.

    With d = weight * (hit - least) and its running sum D, a window [s, e) passes only if D[e] >= D[s]; the greatest
    D within reach of each s comes from maxima over doubling spans.
    """
    run = np.concatenate([[0.0], np.cumsum(np.where(any_hit, weights * (1 - least), weights * -least))])
    near, far = min(sizes) - 1, max(sizes) - 1
    ahead = np.concatenate([run, np.full(far, -np.inf)])
    best, span = ahead.copy(), 1
    while 2 * span <= far - near + 1:
        best[: len(best) - span] = np.maximum(best[: len(best) - span], best[span:])
        span *= 2
    first = best[near : near + len(any_hit)]
    last = best[far - span + 1 : far - span + 1 + len(any_hit)]
    return np.flatnonzero(np.maximum(first, last) >= run[:-1] - 1e-6)


def _enough(hit: np.ndarray, whole: np.ndarray, lightest: int, least: float) -> np.ndarray:
    """Whether a window whose hits weigh so much can be similar enough to an item that weighs at least `lightest`.

    The overlap is at most `hit`; the union is at least the window's weight, and both weights less the overlap.
    """
    return hit >= np.maximum(least * whole, least / (1 + least) * (whole + lightest)) - 1e-6


def screened(flat: np.ndarray, offsets: np.ndarray, screen: np.ndarray, sizes: dict[int, int], least: float, min_words: int) -> list[tuple[int, int, int]]:
    """(text, first shingle, number of shingles) of the windows of all sizes, two words at least, that could be similar enough."""
    if len(flat) < 2 or not sizes:
        return []
    shingles = weigh(flat)
    weights = weights_of(shingles)
    bits = len(screen).bit_length() - 1
    slot = _slots(shingles, bits)
    last = offsets[1:-1] - 1  # shingles that reach into the next text
    last = last[(last >= 0) & (last < len(weights))]
    weights[last] = FAR
    any_hit = screen[slot]
    any_hit[last] = False
    if not any_hit.any():
        return []
    counts = np.maximum(0, np.diff(offsets) - 1)
    begin = promising(any_hit, np.minimum(weights, 1 << 20), sizes, least)
    short = np.flatnonzero((counts > 0) & (counts < max(sizes) - 1))
    texts = np.unique(np.concatenate([np.searchsorted(offsets, begin, "right") - 1, short]))
    if len(texts) < len(counts):
        if len(texts) == 0:
            return []
        some = np.concatenate([flat[offsets[t] : offsets[t + 1]] for t in texts])
        return [(int(texts[t]), s, k) for t, s, k in screened(some, np.concatenate([[0], np.cumsum(np.diff(offsets)[texts])]), screen, sizes, least, min_words)]
    at = np.flatnonzero(any_hit)
    total = np.concatenate([[0], np.cumsum(weights)])
    found = []
    for size, lightest in sizes.items():
        k, need = size - 1, 1.0 if size < min_words else least
        own = at[screen[slot[at] ^ _salt(size, bits)]]
        if len(own) == 0:
            continue
        hit = np.zeros(len(weights) + 1, np.int64)
        hit[own + 1] = weights[own]
        hit = np.cumsum(hit)
        if len(weights) >= k:
            start = np.flatnonzero(_enough(hit[k:] - hit[:-k], total[k:] - total[:-k], lightest, need))
            found += [(int(t), int(s - offsets[t]), k) for t, s in zip(np.searchsorted(offsets, start, "right") - 1, start, strict=True)]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            a, b = offsets[short], offsets[short] + counts[short]
            found += [(int(t), 0, int(counts[t])) for t in short[_enough(hit[b] - hit[a], total[b] - total[a], lightest, need)]]
    return list(dict.fromkeys(found))


def _near(reach: int) -> np.ndarray:
    """All 16-bit patterns of at most `reach` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(16), n)], np.int64)


def _block(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_words): the most similar window of each document and item that pass.

    Ties go to the smaller distance, then the earlier and the shorter window. A document shorter than an item's
    window is one window. An item of fewer than min_words words is found only where its words stand in a row as they
    are, and an item of one word only as a whole text. Items that are null or wordless or have a null id are left out;
    items that share an id count as one. Null and empty texts have no windows; rows that share a doc_id count as one document,
    rows with a null doc_id too. Other columns are not read. Empty tables give an empty result.
    """
    items = written(_items(benchmark), "items")
    screen, sizes = _screen(items)
    single = sizes.pop(1, None) is not None
    packed, bits = np.packbits(screen), len(screen)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by MAP_BITS

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.unpackbits(shared.value, count=bits).astype(bool)
        for frame in frames:
            for begin in range(0, len(frame), 500):
                part = frame.iloc[begin : begin + 500]
                flat, offsets = hash_texts(part["text"])
                ids, by_text = part["doc_id"].tolist(), {}
                for text, start, k in screened(flat, offsets, seen, sizes, least, min_words):
                    by_text.setdefault(text, []).append((start, start + k))
                for text in np.flatnonzero(np.diff(offsets) == 1).tolist() if single else ():
                    by_text.setdefault(text, []).append((0, 1))
                for text, spans in by_text.items():
                    shingles, spans = weigh(flat[offsets[text] : offsets[text + 1]]), np.array(spans)
                    fps = fingerprints(shingles, spans[:, 0], spans[:, 1])
                    for at in range(0, len(spans), 2000):
                        rows = [(ids[text], a, min(b - a + 1, int(offsets[text + 1] - offsets[text])), fp, shingles[a:b].view(np.int64)) for (a, b), fp in zip(spans[at : at + 2000], fps[at : at + 2000], strict=True)]
                        yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "first_word", "n_words", "fp", "shingles"]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(windows, "doc_id long, first_word int, n_words int, fp long, shingles array<long>")
    reach = radius // 4
    near = F.array(*(F.lit(int(x)) for x in _near(reach)))
    index = items.select("item_id", F.col("fp").alias("item_fp"), F.posexplode(F.array(*(_block(F.col("fp"), b) for b in range(4)))).alias("block", "v"))
    index = index.withColumn("value", F.explode(F.transform(near, lambda x: F.col("v").bitwiseXOR(x.cast("long"))))).drop("v")
    probes = found.select("*", F.posexplode(F.array(*(_block(F.col("fp"), b) for b in range(4)))).alias("block", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # the first block that agrees stands for the pair
    earlier = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda b: (b >= F.col("block")) | (F.bit_count(F.element_at(F.array(*(_block(apart, x) for x in range(4))), b + 1)) > reach))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(*x) for x in zip(a, b, strict=True)], dtype=float)

    # the index is many times as large as its source, which the planner cannot know: no broadcast unless measured
    pairs = probes.join(index.hint("merge"), ["block", "value"]).withColumn("hamming", F.bit_count(apart)).filter((F.col("hamming") <= radius) & earlier)
    pairs = pairs.join(items.select("item_id", F.col("fp").alias("item_fp"), F.col("size").alias("item_size"), F.col("shingles").alias("item_shingles")), ["item_id", "item_fp"])
    pairs = pairs.filter((F.col("item_size") >= min_words) | (F.col("shingles") == F.col("item_shingles")))
    pairs = pairs.withColumn("similarity", alike("shingles", "item_shingles")).filter(F.col("similarity") >= least)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "hamming", "first_word", "n_words")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), "best.hamming", "best.first_word", "best.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns as they are, but those whose doc_id has a leak; rows with a null doc_id stay."""
    return without(docs, leaks(docs, benchmark, **settings).select("doc_id"))
