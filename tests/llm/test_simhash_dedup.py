import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from notegrove.llm import simhash_dedup as op
from notegrove.llm._shared import hash_texts, mix, shingle_hashes
from tests.llm.conftest import prose


def near(seed, words, edits):
    rng, text = random.Random(seed), prose(seed % 40, words).split(" ")
    for _ in range(edits):
        text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
    return " ".join(text)


def brute(prints, ids, radius, check):
    """Components over all pairs."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    apart = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)).sum()
    for i in range(len(ids)):
        for j in range(i):
            if apart(prints[i, :1], prints[j, :1]) <= radius and apart(prints[i, 1:], prints[j, 1:]) <= check:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


@pytest.mark.parametrize("codes", [((float("inf"), (op.GOLAY,)),), ((float("inf"), (op.GOLAY, op.HAMMING)),), ((float("inf"), (op.GOLAY, op.HAMMING, op.BIT, op.BIT)),)])
def test_groups_equal_brute_force(spark, codes):
    texts = [near(k, 120, k % 9) for k in range(160)]
    prints, full = op.fingerprints(texts)
    assert full.all()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in op.assign_groups(docs, codes=codes).collect()}
    assert got == brute(prints, list(range(160)), op.RADIUS, op.CHECK_RADIUS)
    assert len(set(got.values())) < 120


def trigrams(text):
    words = text.split(" ")
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def test_near_copies_by_shingles_are_within_the_radii():
    """Of pairs with a trigram similarity of 0.6 at least, short ones included, nine in ten; of different texts none."""
    rng, texts = random.Random(3), []
    for k in range(400):
        words = prose(1000 + k, rng.choice([55, 75, 95, 150, 300])).split(" ")
        copy = list(words)
        for _ in range(max(1, len(words) // 13)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(copy)]
    prints = op.fingerprints(texts)[0]
    within = lambda a, b: (np.bitwise_count((a[:, :1] ^ b[:, :1]).view(np.uint64)).sum(1) <= op.RADIUS) & (np.bitwise_count((a[:, 1:] ^ b[:, 1:]).view(np.uint64)).sum(1) <= op.CHECK_RADIUS)
    near_by = within(prints[::2], prints[1::2])
    sizes = np.array([len(t.split(" ")) for t in texts[::2]])
    like = np.array([len(trigrams(a) & trigrams(b)) / len(trigrams(a) | trigrams(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)])
    for least, most in ((0, 100), (100, 1000)):
        found = near_by[(like >= 0.6) & (sizes >= least) & (sizes < most)]
        assert len(found) > 50 and found.mean() >= 0.9
    assert not any(within(prints[::2], np.roll(prints[1::2], k, 0)).any() for k in range(1, 400))


def test_slices_of_full_anchors_find_the_same_groups(spark, monkeypatch):
    texts = [near(k, 120, k % 9) for k in range(160)]
    monkeypatch.setattr(op, "BUCKET_ROWS", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in op.assign_groups(docs).collect()}
    assert got == brute(op.fingerprints(texts)[0], list(range(160)), op.RADIUS, op.CHECK_RADIUS)


@pytest.mark.parametrize("settings", [{"BUCKET_ROWS": 1}, {"GROUP": 50}, {"GROUP": 90, "SHARE": 20, "TASKS": 8}])
def test_groups_shares_and_slices_change_no_group(spark, monkeypatch, settings):
    texts = [near(k, 120, k % 9) for k in range(160)] + ["", "one", "one two", "x " * 300]
    for name, value in settings.items():
        monkeypatch.setattr(op, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in op.assign_groups(docs, codes=op.CODES if "BUCKET_ROWS" in settings else None).collect()}
    full = [k for k, text in enumerate(texts) if text]
    assert got == brute(op.fingerprints([texts[k] for k in full])[0], full, op.RADIUS, op.CHECK_RADIUS) | {160: 160}


@pytest.mark.parametrize("size", [1, 40, 60])
def test_groups_in_a_ring_miss_no_link(spark, monkeypatch, size):
    """Of one text each, 5 or 3 groups; no task compares a group with itself alone."""
    prints = np.unique(op.fingerprints([near(k, 120, k % 9) for k in range(160 if size > 1 else 5)])[0], axis=0)
    monkeypatch.setattr(op, "GROUP", size)
    splits, link = [], op.link
    monkeypatch.setattr(op, "link", lambda prints, split, *rest: splits.append(split) or link(prints, split, *rest))
    distinct = spark.createDataFrame([(k, *map(int, row)) for k, row in enumerate(prints)], "id long, fp long, v1 long, v2 long, v3 long")
    links = np.array([(r.a, r.b) for r in op.near_links(distinct, len(prints)).collect()], int).reshape(-1, 2)
    label = np.arange(len(prints))
    op._merge(label, links[:, 0], links[:, 1])
    assert dict(enumerate(label.tolist())) == brute(prints, list(range(len(prints))), op.RADIUS, op.CHECK_RADIUS)
    assert 0 not in splits


def test_fingerprints_are_signs_of_all_votes(monkeypatch):
    """One by one, in batches and alone; words that a text has once are not spread into a number for each bit."""
    texts = [None, "", "one", "one two", "one one", "x " * 300, "a b c " * 200, *(prose(k, 30 * k) for k in range(1, 20)), " ".join(f"w{k}" for k in range(3000)), "", None]
    spread, unpack = [], np.unpackbits

    def expected(text):
        words = hash_texts([text])[0]
        one, both = Counter(words.tolist()), Counter(np.concatenate([words, shingle_hashes(words, 2)]).tolist())
        values = []
        for counts, power, seed in ((one, op.POWER, 9), *((both, 0.5, 100 + v) for v in range(3))):
            votes = [(h, float(np.float32(n) ** power)) for h, n in zip(mix(np.array(list(counts), np.uint64), seed).tolist(), counts.values(), strict=True)]
            values.append(sum(1 << bit for bit in range(64) if round(sum(w if h >> bit & 1 else -w for h, w in votes), 3) > 0))
        return np.array(values, np.uint64).view(np.int64).tolist()

    wanted = [expected(t) for t in texts]
    monkeypatch.setattr(np, "unpackbits", lambda x, **how: spread.append(len(x)) or unpack(x, **how))
    prints, full = op.fingerprints(texts)
    assert prints.tolist() == wanted and full.tolist() == [bool(t) for t in texts]
    assert sum(spread) < 2000 < len(texts[-3].split())
    monkeypatch.setattr(op, "WORDS", 100)
    assert op.fingerprints(texts)[0].tolist() == wanted


def test_a_search_task_keeps_few_bytes_a_text():
    """So that larger groups fit, each of which meets fewer others."""
    prints = np.random.default_rng(4).integers(0, 1 << 63, (400_000, 4)).astype(np.uint64)
    masks = op.covering_masks(op.CHECK_RADIUS)[:2]
    tracemalloc.start()
    op.link(prints, 0, masks, op.RADIUS, op.CHECK_RADIUS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * len(prints)


@pytest.mark.parametrize("radius", [0, 3, 11, 36, 40])
def test_masks_cover_all_within_the_radius(radius):
    """Random sets of bits, and sets that spread evenly over the parts or fill one."""
    rng, masks = np.random.default_rng(radius), op.covering_masks(radius)
    for k in range(300):
        flipped = [rng.choice(192, radius, False), np.arange(radius) * 192 // max(1, radius), (np.arange(radius) + k) % 192][k % 3]
        bits = np.zeros(192, np.uint8)
        bits[flipped] = 1
        assert (np.packbits(bits, bitorder="little").view(np.uint64) & masks == 0).all(1).any()
    assert (np.bitwise_count(masks).sum(1) > 0).all()


@pytest.mark.parametrize("split", [0, 1500])
def test_texts_alike_in_the_first_fingerprint_are_not_compared_one_by_one(monkeypatch, split):
    """As texts of one language are. Links equal those of all pairs; those that agree on masks by chance are few."""
    rng, n, count = np.random.default_rng(2), 4000, np.bitwise_count
    prints = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    prints[:, 0] = 7
    for k in range(3000, n):  # near copies, of which some are just within the radius and some just beyond
        prints[k] = prints[k - 3000 if k < 3900 else k - 1]
        for bit in rng.choice(192, rng.integers(30, 40), False):
            prints[k, 1 + bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b = np.nonzero(sum(count(prints[:, None, w] ^ prints[None, :, w]).astype(int) for w in (1, 2, 3)) <= op.CHECK_RADIUS)
    wanted, apart = np.arange(n), (a < split) != (b < split) if split else a < b
    op._merge(wanted, a[apart], b[apart])
    compared = []
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    got = op.link(prints, split, op.covering_masks(op.CHECK_RADIUS), op.RADIUS, op.CHECK_RADIUS)
    assert (got == wanted).all() and 200 < (got != np.arange(n)).sum()
    assert sum(compared) < n * n / 20


@pytest.mark.parametrize("blocks", [(op.GOLAY,), (op.HAMMING, op.BIT), (op.GOLAY, op.HAMMING)])
def test_every_value_within_reach_is_replicated_home(blocks):
    rng, bits = np.random.default_rng(1), sum(b[0] for b in blocks)
    x = rng.integers(0, 1 << bits, 300)
    for flips in range(4):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, bits, len(y))
        home = op.anchors(x, blocks, 3)[0]
        _, rows, reached = op.anchors(y, blocks, 3)
        sets = [set() for _ in x]
        for r, a in zip(rows, reached, strict=True):
            sets[r].add(a)
        assert all(h in s for h, s in zip(home, sets, strict=True))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (200, 202)] + [(7, 7)]
    got = {r.id: r.root for r in op.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {k: 200 for k in range(200, 203)}
    assert op.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(edge, empty):
    groups = {r.doc_id: (r.doc_ids, r.n_docs) for r in op.near_duplicate_groups(edge).collect()}
    assert groups == {k: ([k], 1) for k in (1, 2, 3, 4, 7, 8)} | {5: ([5, 6], 2)}
    kept = op.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert op.near_duplicate_groups(empty).count() == 0 and op.drop_near_duplicates(empty).count() == 0
