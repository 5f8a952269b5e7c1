"""Near-duplicate groups by SimHash and covering masks.

Each text gets a 64-bit SimHash of its words and a 192-bit SimHash of its words and word pairs. Two texts are near
duplicates when the first differ in at most `radius` bits and the second in at most `check_radius`; groups are the
connected components, and the smallest doc_id of a group stays.

Search. Masks cover all ways in which two 192-bit fingerprints can differ in `check_radius` bits (R. Pagh, "CoveringLSH"). Bits
are cut into parts with a radius t each, t+1 summing to check_radius+1 over the parts, so that within check_radius one part
agrees within its t. A part's bits get vectors of t+1 bits; each non-zero vector gives a mask, the bits whose vectors have an odd
product with it. Any t bits leave a non-zero vector orthogonal to theirs, so texts within t agree on that vector's mask in
full: sorting by each mask finds every pair, and the search is exact. The 64-bit fingerprints decide few unrelated texts (those
of one language share most bits), so they check what the masks bring together. Texts are cut into groups by hash, a task takes
two groups, in a ring also the first with itself, and a share of the masks, and returns links enough for the same components;
what is linked already is not compared again. Neither groups, shares nor the choice of vectors change what is found.

The older search by anchor points stays for comparison: see near_pairs. Of two fingerprints within radius 4t+3, one of four
pieces agrees within t. A product of perfect codes (Golay [23,12] with covering radius 3, Hamming [7,4] with radius 1, single
bits with radius 0) serves as anchors of a piece: every value has its home anchor within the covering radius of each block, and
is replicated to every anchor within covering radius plus excess, excesses summing to t at most. By the triangle inequality a
value within t of another is replicated to that one's home, so comparing homes with replicas at each anchor finds every pair.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrove.llm._shared import col, fresh_name, hash_texts, mix, pack_bits, shingle_hashes, without, written

#: Bits of the 64 and of the 192 in which near duplicates may differ; pieces of the 64.
RADIUS, CHECK_RADIUS, PIECES = 11, 36, 4
#: Exponent of a word's count in the first fingerprint: edits weigh little against the words a text repeats.
POWER = 0.65
#: (distinct fingerprints up to which a set of blocks is used, the blocks); a block is (length, generator, covering radius).
GOLAY, HAMMING, BIT = (23, 0b101011100011, 3), (7, 0b1011, 1), (1, 0b1, 0)
CODES = ((float("inf"), (GOLAY,)),)
#: Words that are fingerprinted at one go, about; a longer text goes by itself.
WORDS = 100_000
#: Homes and replicas of one Python call in the comparison, about, fingerprint pairs compared at once, and fingerprints spread at once.
BUCKET_ROWS, HOME_PAIRS, BATCH = 2_000_000, 4_000_000, 5_000
#: Keys of a mask handled at one go, and pairs of its runs compared at one go: arrays that stay in a core's cache.
KEYS, BLOCK_PAIRS = 1 << 16, 1 << 16
PRINTS = ("fp", "v1", "v2", "v3")
#: Texts of a group, two of which a task compares or up to twice as many at once; tasks that share the masks where groups are few, and texts for which one more is worth it; t+1 of a part, about.
GROUP, TASKS, SHARE, UNITS = 800_000, 24, 10_000, 7
_LOW_BITS = np.uint64(0x0101010101010101)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four signed 64-bit values, and which texts have words at all (the others' rows are zero)."""
    flat, offsets = hash_texts(texts)
    out, at = np.zeros((len(texts), 4), np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, "right")) - 1)
        words, bounds = flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        # a text's last word begins no pair
        pairs = np.delete(shingle_hashes(np.append(words, words[:1]), 2), bounds[1:][np.diff(bounds) > 0] - 1)
        pair_bounds = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(bounds) - 1))])
        words, counts, bounds = _distinct(words, bounds)
        out[at:end, 0] = pack_bits(np.round(_votes([mix(words, 9)], counts.astype(np.float32) ** POWER, bounds)[0], 3) > 0)
        total = _votes([mix(words, 100 + v) for v in range(3)], np.sqrt(counts).astype(np.float32), bounds)
        pairs, counts, bounds = _distinct(pairs, pair_bounds)
        total += _votes([mix(pairs, 100 + v) for v in range(3)], np.sqrt(counts).astype(np.float32), bounds)
        for v in range(3):
            out[at:end, v + 1] = pack_bits(np.round(total[v], 3) > 0)
        at = end
    return out, np.diff(offsets) > 0


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text, how often it has them, and the texts' bounds among these."""
    hashes = hashes.copy()
    for start, end in itertools.pairwise(bounds.tolist()):
        hashes[start:end].sort()
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(first)
    return hashes[at], np.diff(at, append=len(hashes)), np.searchsorted(at, bounds)


def _votes(kinds: list[np.ndarray], weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each kind of hash and text, its rows' votes for each bit: +w where it is set and -w where not.

    Rows of weight 1, which most are, are counted in the bytes of 64-bit sums, 255 rows at most in each.
    """
    total = np.zeros((len(kinds), len(bounds) - 1, 64))
    alone = weights == 1
    once, more = np.flatnonzero(alone), np.flatnonzero(~alone)
    ends, rest = np.searchsorted(once, bounds), np.searchsorted(more, bounds)
    sums = -(-np.diff(ends) // 255)
    text = np.repeat(np.arange(len(sums)), sums)
    starts = ends[text] + 255 * (np.arange(len(text)) - np.repeat(np.cumsum(sums) - sums, sums))
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    weights = weights[more].astype(np.float64)
    for k, hashes in enumerate(kinds if len(text) else []):
        rows, set_bits = hashes[once], np.zeros((len(text), 8, 8), np.int64)
        for bit in range(8):
            set_bits[:, :, bit] = np.add.reduceat(rows >> np.uint64(bit) & _LOW_BITS, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total[k, text[begin]] = 2 * np.add.reduceat(set_bits.reshape(-1, 64), begin)
    total -= np.diff(ends)[:, None]
    others = np.stack([hashes[more] for hashes in kinds], 1).view(np.uint8)
    for t in np.flatnonzero(np.diff(rest)).tolist():
        for at in range(rest[t], rest[t + 1], 100_000):
            w = weights[at : min(at + 100_000, rest[t + 1])]
            bits = np.unpackbits(others[at : at + len(w)], axis=1, bitorder="little").astype(np.float64)
            total[:, t] += 2 * (w @ bits).reshape(-1, 64) - w.sum()
    return total


@functools.lru_cache(maxsize=8)
def _block(length: int, generator: int, radius: int, most: int) -> tuple[int, np.ndarray, np.ndarray, list]:
    """Number of check bits; syndrome of each value; leader of each coset; patterns of each coset and excess."""
    checks = generator.bit_length() - 1
    rest = np.arange(1 << length, dtype=np.int64)
    for bit in range(length - 1, checks - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (generator << (bit - checks)), rest)
    weight = np.bitwise_count(np.arange(1 << length, dtype=np.uint64)).astype(int)
    by = [[np.zeros(0, np.int64)] * (most + 1) for _ in range(1 << checks)]
    leaders = np.zeros(1 << checks, np.int64)
    light = np.flatnonzero(weight <= radius + most)
    light = light[np.lexsort((light, weight[light], rest[light]))]
    starts = np.searchsorted(rest[light], np.arange((1 << checks) + 1))
    for s in range(1 << checks):
        own = light[starts[s] : starts[s + 1]]
        excess = np.maximum(0, weight[own] - radius)
        leaders[s] = own[0]
        by[s] = [own[excess == e] for e in range(most + 1)]
    return checks, rest.astype(np.int32), leaders, by


@functools.lru_cache(maxsize=8)
def _patterns(blocks: tuple, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each joint syndrome, the patterns that lead to anchors within reach: all end to end, and offsets."""
    lists: list[list[np.ndarray]] = [[np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * most]
    shift = 0
    for block in blocks:
        by = _block(*block, most)[3]
        joined = []
        for left in lists:
            for right in by:
                joined.append([np.concatenate([(left[a][:, None] | (right[e - a][None, :] << shift)).ravel() for a in range(e + 1)]) for e in range(most + 1)])
        lists, shift = joined, shift + block[0]
    whole = [np.concatenate(x) for x in lists]
    return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])])


def anchors(halves: np.ndarray, blocks: tuple, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each half; then, for all replicas, the row each stands for and its anchor."""
    syndrome, home, shift = np.zeros(len(halves), np.int64), np.zeros(len(halves), np.int64), 0
    for length, generator, radius in blocks:
        checks, rest, leaders, _ = _block(length, generator, radius, most)
        part = halves >> shift & ((1 << length) - 1)
        own = rest[part].astype(np.int64)
        syndrome = (syndrome << checks) + own
        home |= (part ^ leaders[own]) << shift
        shift += length
    kept = halves & ((1 << shift) - 1)
    flat, offsets = _patterns(blocks, most)
    counts = offsets[syndrome + 1] - offsets[syndrome]
    rows = np.repeat(np.arange(len(halves)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return home, rows, kept[rows] ^ flat[offsets[syndrome][rows] + within]


def _compare(ids: np.ndarray, prints: np.ndarray, home: np.ndarray, radius: int, check_radius: int) -> tuple[list, list]:
    """Pairs of a home and a replica with a larger id within both radii."""
    left, right = [], []
    h, hp = ids[home], prints[home]
    r, rp = ids[~home], prints[~home]
    step = max(1, HOME_PAIRS // max(1, len(r)))
    for at in range(0, len(h), step):
        a, b = np.nonzero(np.bitwise_count(hp[at : at + step, :1] ^ rp[None, :, 0]) <= radius)
        a += at
        a, b = a[h[a] < r[b]], b[h[a] < r[b]]
        near = np.bitwise_count(hp[a, 1:] ^ rp[b, 1:]).sum(1) <= check_radius
        left.append(h[a[near]])
        right.append(r[b[near]])
    return left, right


def near_pairs(distinct: DataFrame, count: int, radius: int = RADIUS, check_radius: int = CHECK_RADIUS, codes: tuple = CODES) -> DataFrame:
    """(a, b), a < b: rows of `distinct` (id, fp, v1, v2, v3; one row per fingerprint) within both radii; a pair can come twice.

    All pairs, by anchor points: 20 times the work of near_links and more where texts share much of the 64 bits.
    """
    blocks = next(b for most, b in codes if count <= most)
    edges = [64 * k // PIECES for k in range(PIECES + 1)]
    excess = radius // PIECES
    replicas = PIECES * len(_patterns(blocks, excess)[0]) / (len(_patterns(blocks, excess)[1]) - 1)
    most = PIECES << sum(length - generator.bit_length() + 1 for length, generator, _ in blocks)
    slices = int(count * replicas / most / BUCKET_ROWS) + 1
    replicas += PIECES * slices
    buckets = max(8, int(count * replicas / BUCKET_ROWS) + 1)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                ids, four = frame["id"].to_numpy()[at : at + BATCH], frame[list(PRINTS)].to_numpy()[at : at + BATCH]
                keys, who, homes = [], [], []
                for piece, (start, end) in enumerate(itertools.pairwise(edges)):
                    value = four[:, 0].astype(np.uint64) >> np.uint64(start) & np.uint64((1 << end - start) - 1)
                    home, rows, anchor = anchors(value.astype(np.int64), blocks, excess)
                    own = (mix(ids[rows], 5) % np.uint64(slices)).astype(np.int64)
                    keys.append(np.concatenate([np.repeat(home, slices) | (np.tile(np.arange(slices), len(home)) << 40), anchor | (own << 40)]) << 2 | piece)
                    who.append(np.concatenate([np.repeat(np.arange(len(ids)), slices), rows]))
                    homes.append(np.arange(len(keys[-1])) < len(home) * slices)
                keys, who, homes = map(np.concatenate, (keys, who, homes))
                bucket = (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((keys, bucket))
                bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
                own = [order[a:b] for a, b in itertools.pairwise(bounds)]
                yield pd.DataFrame({"bucket": [bucket[o[0]] for o in own], "load": [_load(ids, four, keys[o], who[o], homes[o]) for o in own]})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, prints, anchor, who, home = _unload(frame["load"])
        order = np.argsort(anchor, kind="stable")
        who, home, anchor = who[order], home[order], anchor[order]
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end - start > 1 and home[start:end].any():
                a, b = _compare(ids[who[start:end]], prints[who[start:end]], home[start:end], radius, check_radius)
                left += a
                right += b
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    return distinct.select("id", *PRINTS).mapInPandas(spread, "bucket int, load binary").groupBy("bucket").applyInPandas(compare, "a long, b long")


@functools.lru_cache(maxsize=8)
def covering_masks(radius: int, bits: int = 192) -> np.ndarray:
    """Rows of 64-bit words: of any two values that differ in at most `radius` of the bits, one row's bits are all alike."""
    parts = max(1, (radius + 1) // UNITS)
    least, more = divmod(radius + 1, parts)
    units = [least] * (parts - more) + [least + 1] * more
    edges = [bits * int(x) // (radius + 1) for x in np.cumsum([0, *units])]
    out = []
    for k, (start, end) in enumerate(itertools.pairwise(edges)):
        # vectors with their lowest bit set, no two alike as far as they go; of some choices the one whose masks bring fewest texts together
        best = np.inf
        for seed in range(100):
            vectors = np.resize(np.random.default_rng([k, seed]).permutation(1 << units[k] - 1), end - start) * 2 + 1
            chosen = (np.bitwise_count(vectors[None, :] & np.arange(1, 1 << units[k])[:, None]) & 1).astype(np.uint8)
            if (cost := (0.5 ** chosen.sum(1)).sum()) < best:
                best, rows = cost, np.zeros((len(chosen), bits), np.uint8)
                rows[:, start:end] = chosen
        out.append(np.packbits(rows, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives all that the links (a, b) connect the smallest label among them, in place."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _mixed(own: np.ndarray, same: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs have rows of several labels; `same` tells of each row whether the next is of its run."""
    turns = same.copy()
    turns[:-1] &= own[1:] != own[:-1]
    return np.maximum.reduceat(turns.view(np.uint8), start) > 0 if len(start) else np.zeros(0, bool)


def link(prints: np.ndarray, split: int, masks: np.ndarray, radius: int, check_radius: int, own: bool = False) -> np.ndarray:
    """For each row of prints the first row of its component over the pairs within both radii that agree on one of the masks.

    With a `split` above 0 only pairs of a row before it and one from it on count, with `own` those of two before it too.
    """
    n, label = len(prints), np.arange(len(prints), dtype=np.int32)
    first, *words = np.ascontiguousarray(prints.T)
    del prints
    shift = np.uint64(max(1, n - 1).bit_length())
    low, number, key = np.uint64((1 << int(shift)) - 1), np.arange(KEYS, dtype=np.uint64), np.empty(n, np.uint64)
    left, right, held = [], [], 0
    for mask in masks:
        for at in range(0, n, KEYS):
            part = key[at : at + KEYS]
            part[:] = 0
            for word, m, odd in zip(words, mask, _ODD, strict=True):
                if m:
                    part ^= (word[at : at + KEYS] & m) * odd
            part ^= part >> np.uint64(32)
            part *= _ODD[0]
            part &= ~low
            part |= number[: len(part)] + np.uint64(at)
        key.sort()
        end = 0
        while end < n:  # some keys at a time, the last run of them in full
            at, end = end, int(np.searchsorted(key, key[min(n, end + KEYS) - 1] | low, "right"))
            same = np.append(np.diff(key[at:end] >> shift) == 0, False)
            ends = np.flatnonzero(np.diff(same, prepend=False, append=False))
            start, size = ends[::2], ends[1::2] - ends[::2] + 1
            order = (key[at:end] & low).astype(np.intp)
            kept = _mixed(label[order], same, start)
            start, size = start[kept], size[kept]
            # each row of a run is compared with those after it or, as rows before the split come first, each such row with those from the split on
            early = np.diff(np.concatenate([[0], np.cumsum(order < split)])[np.stack([start, start + size])], axis=0)[0] if split else size - 1
            row = np.arange(early.sum()) + np.repeat(start - np.cumsum(early) + early, early)
            other = np.repeat(start + early, early) if split and not own else row + 1
            count, fp, k = np.repeat(start + size, early) - other, first[order], 0
            done = np.cumsum(count)
            while k < len(row):
                base = int(done[k - 1]) if k else 0
                to = max(k + 1, int(np.searchsorted(done, base + BLOCK_PAIRS, "right")))
                each, upto = count[k:to], done[k:to] - base
                place = np.arange(upto[-1]) + np.repeat(other[k:to] - upto + each, each)
                near = np.flatnonzero(np.bitwise_count(np.repeat(fp[row[k:to]], each) ^ fp[place]) <= radius)
                a, b = order[row[k + np.searchsorted(upto, near, "right")]], order[place[near]]
                fresh = label[a] != label[b]
                a, b, k = a[fresh], b[fresh], to
                close = sum(np.bitwise_count(word[a] ^ word[b]).astype(np.int64) for word in words) <= check_radius
                left.append(a[close])
                right.append(b[close])
                held += len(left[-1])
                if held > n // 50:
                    _merge(label, np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
                    turns = _mixed(label[order], same, ends[::2])
                    kept = k + np.flatnonzero(turns[np.searchsorted(ends[::2], row[k:], "right") - 1])
                    row, other, count, k = row[kept], other[kept], count[kept], 0
                    done = np.cumsum(count)
    if held:
        _merge(label, np.concatenate(left), np.concatenate(right))
    return label


def near_links(distinct: DataFrame, count: int, radius: int = RADIUS, check_radius: int = CHECK_RADIUS) -> DataFrame:
    """(a, b), a <> b: links among rows of `distinct` whose components are those of all pairs within both radii; one can come twice.

    `distinct` is (id, fp, v1, v2, v3), one row per fingerprint, and `count` its number of rows, which only decides how the work is cut.
    """
    groups = -(-count // GROUP) if count > 2 * GROUP else 1
    # by task: its groups, the early one first; in a ring each group meets itself where it meets the next one
    tiles = [(i, j) if j - i < groups - 1 else (j, i) for i, j in itertools.combinations(range(groups), 2)] or [(0, 0)]
    shares = max(1, min(-(-TASKS // len(tiles)), count // SHARE))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, four = frame["id"].to_numpy(), frame[list(PRINTS)].to_numpy()
            group = (mix(ids, 5) % np.uint64(groups)).astype(np.int64)
            for g in np.unique(group).tolist():
                load = ids[group == g].astype("<i8").tobytes() + four[group == g].astype("<i8").tobytes()
                tasks = [(t * shares + share, g == tile[0]) for t, tile in enumerate(tiles) if g in tile for share in range(shares)]
                yield pd.DataFrame({"task": [t for t, _ in tasks], "early": [e for _, e in tasks], "load": [load] * len(tasks)})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        task, early = int(frame["task"].iloc[0]), frame["early"].to_numpy(bool)
        loads = [frame["load"].iloc[k] for k in np.argsort(~early, kind="stable")]
        ends = np.cumsum([0, *(len(load) // 40 for load in loads)])
        ids, prints, split = np.empty(ends[-1], np.int64), np.empty((4, ends[-1]), np.uint64), int(ends[early.sum()])
        for load, (start, end) in zip(loads, itertools.pairwise(ends), strict=True):
            ids[start:end] = np.frombuffer(load, "<i8", end - start)
            prints[:, start:end] = np.frombuffer(load, "<u8", 4 * (end - start), 8 * (end - start)).reshape(-1, 4).T
        i, j = tiles[task // shares]
        own = groups == 1 or (i + 1) % groups == j
        if split == 0 or split == len(ids) and not own:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        label = link(prints.T, 0 if i == j else split, covering_masks(check_radius)[task % shares :: shares], radius, check_radius, own)
        other = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[label[other]], "b": ids[other]})

    loads = distinct.select("id", *PRINTS).mapInPandas(spread, "task long, early boolean, load binary")
    return loads.repartition(4 * len(tiles) * shares, "task").groupBy("task").applyInPandas(compare, "a long, b long")


def _load(ids: np.ndarray, four: np.ndarray, keys: np.ndarray, who: np.ndarray, home: np.ndarray) -> bytes:
    """What one batch sends to a bucket: each of its fingerprints once, then homes and replicas by their number in that list.

    Anchors go by bytes of equal weight, most of which are zero, so that shuffles compress them.
    """
    which, at = np.unique(who, return_inverse=True)
    planes = np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return np.array([len(which), len(keys)], "<i4").tobytes() + ids[which].astype("<i8").tobytes() + four[which].astype("<i8").tobytes() + planes.tobytes() + at.astype("<u2").tobytes() + np.packbits(home).tobytes()


def _unload(loads: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and prints of all loads; of all homes and replicas the anchor, the place of its fingerprint in those, and whether it is a home."""
    parts, base = [], 0
    for load in loads:
        n, m = np.frombuffer(load, "<i4", 2).tolist()
        ends = np.cumsum([8, 8 * n, 32 * n, 8 * m, 2 * m])
        read = lambda k, kind, end=None: np.frombuffer(load[ends[k] : end or (ends[k + 1] if k < 4 else None)], kind)  # noqa: B023, E731
        planes = read(2, np.uint8).reshape(8, m)
        parts.append((read(0, "<i8"), read(1, "<u8").reshape(n, 4), np.ascontiguousarray(planes.T).view("<i8").ravel(), read(3, "<u2").astype(np.int64) + base, np.unpackbits(read(4, np.uint8), count=m).astype(bool)))
        base += n
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): each id of the edges (a, b) and the smallest id of its connected component.

    Alternates large-star and small-star steps, each a shuffle of the edges, and writes each round to the shared
    folder; it ends when a round changes nothing.
    """
    now, before = written(edges.filter("a <> b").distinct(), "edges"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        smallest = F.min("b").over(Window.partitionBy("a"))
        # large star: every larger neighbour points to the smallest of the neighbourhood
        large = both.withColumn("m", F.least(smallest, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        small = large.withColumn("m", smallest).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = seen


def assign_groups(docs: DataFrame, radius: int = RADIUS, check_radius: int = CHECK_RADIUS, codes: tuple | None = None) -> DataFrame:
    """(doc_id, keep_id) for every distinct non-null doc_id: the smallest doc_id of its near-duplicate group.

    Texts that are null or have no words are never alike: such a document is its own group. Rows with a null doc_id
    are left out. Rows that share a doc_id, repeated or with other texts, count as one document, which is like
    whatever any of its texts is like. Other columns are not read. An empty table gives an empty result. With `codes`
    the older search by anchors is used; groups are the same.
    """

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                values, full = fingerprints(part["text"].tolist())
                yield pd.DataFrame({"id": part["doc_id"].to_numpy(), **{c: values[:, k] for k, c in enumerate(PRINTS)}, "full": full})

    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInPandas(sketch, "id long, fp long, v1 long, v2 long, v3 long, full boolean")
    rows = written(rows, "prints")
    full = rows.filter("full").drop("full")
    leaders = full.groupBy(*PRINTS).agg(F.min("id").alias("id"))
    leaders = written(leaders, "leaders")
    count = leaders.count()
    pairs = near_pairs(leaders, count, radius, check_radius, codes) if codes else near_links(leaders, count, radius, check_radius)
    copies = full.join(leaders.withColumnRenamed("id", "a"), list(PRINTS)).select("a", F.col("id").alias("b")).filter("a <> b")
    roots = components(pairs.union(copies))
    return rows.select(F.col("id").alias("doc_id")).distinct().join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("keep_id"))


def near_duplicate_groups(docs: DataFrame, **settings) -> DataFrame:
    """One row a group: doc_id (the document that stays), doc_ids (all members in order), n_docs. See assign_groups."""
    return assign_groups(docs, **settings).groupBy(F.col("keep_id").alias("keep")).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).select(F.col("keep").alias("doc_id"), "doc_ids", F.size("doc_ids").alias("n_docs"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns as they are, that stay when one document of each group does.

    Rows with a null doc_id stay. Of rows that share a doc_id one stays, the first in order of all their values
    as text.
    """
    groups = written(assign_groups(docs, **settings), "groups")
    key, nth = fresh_name(docs, "again"), fresh_name(docs, "nth")
    left = without(docs, groups.filter("doc_id <> keep_id").select("doc_id"))
    twice = written(docs.select(F.col("doc_id").cast("long").alias(key)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "twice")
    same = docs["doc_id"].cast("long") == F.col(key)
    if twice.isEmpty():
        return left
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*(col(c) for c in docs.columns))))
    again = left.join(twice, same, "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).drop(nth)
    return left.join(twice, same, "left_anti").unionByName(again)
