import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from notegrove.llm import _tokenizer, ngram_lm as op
from tests.llm.conftest import prose

coder, stop = _tokenizer.load(), _tokenizer.size()


def plain_em(told, order):
    """Expectation-maximisation in loops over tallied events, without arrays."""
    by_bucket = {}
    for (bucket, *steps), n in sorted(told.items()):
        by_bucket.setdefault(bucket, []).append(([1 / (stop + 1)] + [0 if q < 0 else 2 ** (-q / op.STEPS) for q in steps], n))
    weights = np.full((op.BUCKETS, order + 1), 1 / (order + 1))
    for bucket, rows in by_bucket.items():
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(op.ROUNDS):
            got = [0.0] * (order + 1)
            for p, n in rows:
                whole = sum(a * b for a, b in zip(w, p, strict=True))
                for k in range(order + 1):
                    got[k] += n * w[k] * p[k] / whole
            w = [g / sum(got) for g in got]
        least = [max(x, 1e-6) for x in w]
        weights[bucket] = [x / sum(least) for x in least]
    return weights


def brute(docs, held, order):
    """Counts in dictionaries, EM over single events, scores of each document."""
    def events(text):
        ids = [stop] * (order - 1) + coder.encode_ordinary(text) + [stop]
        return [tuple(ids[k - order + 1 : k + 1]) for k in range(order - 1, len(ids))]

    grams, contexts = Counter(), Counter()
    kept_grams, kept_contexts = Counter(), Counter()
    for k, text in enumerate(docs):
        for e in events(text):
            for n in range(1, order + 1):
                for g, c in ((grams, contexts), (kept_grams, kept_contexts)) if k not in held else ((grams, contexts),):
                    g[e[order - n :]] += 1
                    c[n, e[order - n : -1]] += 1

    def levels(e, g, c, less):
        out = [1 / (stop + 1)]
        for n in range(1, order + 1):
            below = c[n, e[order - n : -1]] - less
            out.append(max(0, g[e[order - n :]] - less) / below if below > 0 else 0)
        return min(int(math.log2(max(0, below) + 1)), op.BUCKETS - 1), out

    told = Counter()
    for k in held:
        for e in events(docs[k]):
            bucket, p = levels(e, kept_grams, kept_contexts, 0)
            told[bucket, *(round(-math.log2(x) * op.STEPS) if x > 0 else -1 for x in p[1:])] += 1
    weights = plain_em(told, order)
    scores = []
    for text in docs:
        total = 0.0
        for e in events(text):
            bucket, p = levels(e, grams, contexts, 1)
            total += math.log2(float(np.dot(weights[bucket], p)))
        scores.append(total)
    return scores, weights


@pytest.mark.parametrize(("order", "sizes"), [(1, {}), (2, {}), (3, {}), (3, {"fan": 2, "bucket_keys": 300, "block": 97}), (2, {"fan": 3, "bucket_keys": 100, "block": 1})])
def test_scores_equal_brute_force(spark, order, sizes):
    """Also with chunks summed in groups of groups, many buckets, and ranges of events that cut documents."""
    docs = [prose(k % 30, 20 + k) for k in range(60)] + ["", "word"]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    held = {r[0] for r in table.selectExpr("doc_id", "pmod(xxhash64(doc_id, text), 4) = 0 AS h").filter("h").collect()}
    got = {r.doc_id: r for r in op.lm_scores(table, order=order, chunk_tokens=900, held_one_in=4, **sizes).collect()}
    want, weights = brute(docs, held, order)
    for k, text in enumerate(docs):
        n = len(coder.encode_ordinary(text))
        assert got[k].n_tokens == n and math.isclose(got[k].log2_prob, want[k], rel_tol=1e-9) and math.isclose(got[k].bits_per_token, -want[k] / (n + 1), rel_tol=1e-9)
    assert np.allclose(weights.sum(1), 1)


def test_rounding_of_held_out_estimates_moves_weights_little():
    """EM over estimates as they are, against those tallied in steps of a quarter bit."""
    rng = np.random.default_rng(4)
    p = np.stack([np.full(5000, 1 / (stop + 1)), rng.uniform(1e-5, 0.05, 5000), np.where(rng.random(5000) < 0.4, 0, rng.uniform(0.01, 1, 5000))], 1)
    w = np.full(3, 1 / 3)
    for _ in range(op.ROUNDS):
        share = p * w
        w = (share / share.sum(1, keepdims=True)).mean(0)
    q = np.where(p[:, 1:] > 0, np.round(-np.log2(np.maximum(p[:, 1:], 1e-30)) * op.STEPS), -1).astype(int)
    cells = pd.DataFrame(q, columns=["q1", "q2"]).assign(bucket=3).groupby(["bucket", "q1", "q2"]).size().reset_index(name="n")
    assert np.abs(op.learn(cells, 2, stop)[3] - w).max() < 0.01


def test_longer_contexts_tell_shuffled_texts_apart(spark):
    """Texts and their sentences with words in another order: order 3 finds the former likelier by more than order 2 does."""
    rng = random.Random(3)
    base = [prose(k, 12).split() for k in range(30)]
    docs = [" ".join(" ".join(base[rng.randrange(30)]) for _ in range(12)) for _ in range(60)]
    mixed = [" ".join(rng.sample(d.split(), len(d.split()))) for d in docs[:6]]
    table = spark.createDataFrame(list(enumerate(docs + mixed)), "doc_id long, text string")
    gap = {}
    for order in (2, 3):
        bits = {r.doc_id: r.bits_per_token for r in op.lm_scores(table, order=order, held_one_in=5).collect()}
        gap[order] = np.mean([bits[60 + k] - bits[k] for k in range(6)])
    assert gap[3] > gap[2] > 0


def test_em_raises_the_held_out_likelihood():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"bucket": rng.integers(0, 3, 200), "q1": rng.integers(10, 60, 200), "q2": rng.integers(-1, 40, 200), "n": rng.integers(1, 50, 200)})

    def likelihood(w):
        p = np.stack([np.full(200, 1 / (stop + 1)), 2.0 ** (-cells["q1"] / op.STEPS), np.where(cells["q2"] < 0, 0, 2.0 ** (-cells["q2"] / op.STEPS))], 1)
        return (cells["n"] * np.log((p * w[cells["bucket"]]).sum(1))).sum()

    values = [likelihood(op.learn(cells, 2, stop, rounds)) for rounds in (0, 1, 3, 10, 60)]
    assert values == sorted(values) and values[0] < values[-1]


def test_edges(edge, empty):
    rows = op.lm_scores(edge, chunk_tokens=5000).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.n_tokens is None:
            assert r.doc_id in (1, None) and r.log2_prob is None and r.bits_per_token is None
        else:
            assert r.log2_prob < 0 and math.isfinite(r.log2_prob)
    assert len({r.log2_prob for r in rows if r.doc_id in (5, 6)}) == 1
    assert op.lm_scores(empty).count() == 0 and op.lm_scores(edge.filter("text IS NULL")).count() == 2
