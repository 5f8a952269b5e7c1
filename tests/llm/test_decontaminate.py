import random

import numpy as np

from notegrove.llm import decontaminate as op
from notegrove.llm._shared import hash_texts, words_of
from tests.llm.conftest import prose


def brute(docs, items, radius=op.RADIUS, least=op.LEAST):
    """Every window of every document against every item, without screening or blocks; short items word by word."""
    best = {}
    for item, text in items:
        words = hash_texts([text])[0]
        if len(words) < op.MIN_WORDS:
            want = words_of(text)
            for doc, body in docs:
                have = words_of(body)
                at = [k for k in range(len(have) - len(want) + 1) if have[k : k + len(want)] == want]
                if at and want and (len(want) > 1 or len(have) == 1):
                    best[doc, item] = (-1.0, 0, at[0], len(want))
            continue
        own = op.weigh(words)
        fp = op.fingerprints(own, np.array([0]), np.array([len(own)]))
        k = len(words) - 1
        for doc, body in docs:
            theirs = op.weigh(hash_texts([body])[0]) if body and len(words_of(body)) > 1 else np.zeros(0, np.uint64)
            for start in range(max(1, len(theirs) - k + 1) if len(theirs) else 0):
                part = theirs[start : start + k]
                far = int(np.bitwise_count((op.fingerprints(part, np.array([0]), np.array([len(part)])) ^ fp).view(np.uint64))[0])
                if far <= radius and (s := op.similarity(part, own)) >= least:
                    key = (-s, far, start, len(part) + 1)
                    best[doc, item] = min(best.get((doc, item), key), key)
    return {k: (-v[0], *v[1:]) for k, v in best.items()}


def cases():
    rng = random.Random(3)
    items = [(k, prose(1000 + k, 12 + 3 * k)) for k in range(18)] + [(90, "too short to tell"), (91, prose(1000, 12)), (92, "solo"), (93, "two words"), (94, prose(1500, 70)), (95, prose(1501, 133)), (96, "?!")]
    docs = []
    for k in range(60):
        words = prose(k, rng.choice([5, 40, 200])).split(" ")
        if k % 2:
            leak = items[k % 18][1].upper().split(" ")
            for _ in range(k % 5):
                leak[rng.randrange(len(leak))] = "changed"
            leak = leak[: len(leak) - (k % 7)]
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((k, " ".join(words)))
    docs.append((60, items[5][1] + ". " + items[6][1]))
    docs.append((61, items[4][1]))
    docs += [(62, "it is Too short, to tell apart"), (63, "too short to. be told"), (64, "Solo!"), (65, "solo words two"), (66, "the two words"), (67, ""), (68, "a " + prose(1500, 70) + " b"), (69, prose(7, 300) + " " + prose(1501, 133).replace("the", "thee", 3) + " " + prose(8, 20)), (70, "two words, two words")]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = cases()
    got = op.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.hamming, r.first_word, r.n_words) for r in got.collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    for key, value in want.items():
        assert np.allclose(got[key], value), key
    assert {(60, 5), (60, 6), (61, 4), (62, 90), (64, 92), (66, 93), (70, 93), (68, 94), (69, 95)} <= got.keys() and not {(63, 90), (65, 92), (65, 93)} & got.keys() and not any(d % 2 == 0 and d < 60 for d, _ in got)


def test_screening_keeps_every_similar_window():
    docs, items = cases()
    sizes, screen = {}, np.zeros(1 << 16, bool)
    for _, text in items:
        own = op.weigh(hash_texts([text])[0])
        size = len(hash_texts([text])[0])
        if size < 2:
            continue
        sizes[size] = min(sizes.get(size, 1 << 40), int(op.weights_of(own).sum()))
        screen[op._slots(own, 16)] = screen[op._slots(own, 16) ^ op._salt(size, 16)] = True
    flat, offsets = hash_texts([t for _, t in docs])
    found = set(op.screened(flat, offsets, screen, dict(sorted(sizes.items())), op.LEAST, op.MIN_WORDS))
    for (doc, _), (_, _, start, n) in brute(docs, items).items():
        assert n == 1 or (doc, start, n - 1) in found


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, prose(5, 80)[:200]), (None, "lost"), (2, None), (3, ""), (4, prose(4, 60_000)[1000:1500])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op.leaks(edge, items).collect()}
    assert got == {(5, 1), (6, 1), (4, 4)}
    kept = op.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 7, 8, 8]
    assert op.leaks(empty, items).count() == 0 and op.leaks(edge, items.limit(0)).count() == 0


def test_word_hashes_equal_one_by_one():
    texts = ["Ünder_score x1 -- naïve", "", None, "a" * 70, "THE the The", prose(1, 3000)]
    flat, offsets = hash_texts(texts)
    assert np.diff(offsets).tolist() == [len(words_of(t)) for t in texts]
    assert len(set(flat[offsets[4] : offsets[5]].tolist())) == 1
    one = np.concatenate([hash_texts([w.decode()])[0] for t in texts for w in words_of(t)])
    assert (one == flat).all()
