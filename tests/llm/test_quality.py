import base64
import random
import string
from collections import Counter

import numpy as np
import zstandard

from notegrove.llm import compression_rules, quality_model, url_rules
from tests.llm.conftest import prose


def junk(seed):
    rng = random.Random(seed)
    return [" ".join(w.upper() + "!!" for w in prose(seed, 60).split()), " ".join(["same"] * 90), "".join(rng.choice("#$%^&*@") for _ in range(300))][seed % 3]


def test_statistics_of_strange_texts():
    for text in (None, "", " ", "\n", "a", "é" * 5000, "x" * 200_000):
        s = quality_model.statistics(text)
        assert s.shape == (len(quality_model.STATS),) and np.isfinite(s).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (40, 16))
    z = quality_model.lift(x, np.zeros(16), np.ones(16), features=20_000, bandwidth=2.0)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4 * 16))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_pool_adjacent_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        v, w = rng.normal(0, 1, 6), rng.uniform(0.5, 2, 6)
        fit = quality_model.pool_adjacent(v, w)
        assert (np.diff(fit) >= -1e-12).all()
        # min-max formula of isotonic regression
        mean = lambda a, b: np.average(v[a : b + 1], weights=w[a : b + 1])  # noqa: B023, E731
        assert np.allclose(fit, [max(min(mean(a, b) for b in range(k, 6)) for a in range(k + 1)) for k in range(6)])


def labelled(spark):
    docs = [(k, prose(k, 30 + k % 200) if k % 4 else junk(k)) for k in range(600)]
    labels = [(k, int(k % 4 > 0), 0) for k in range(400)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    _, table, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_model.quality_scores(table, labels).collect()}
    assert np.mean([got[k].keep == bool(k % 4) for k in range(400, 600)]) > 0.97


def test_fit_equals_dense_ridge_and_its_calibration_the_min_max_formula(spark):
    """All rows in one matrix: weights from least squares with the penalty as rows, levels from their definition."""
    docs, table, labels = labelled(spark)
    model = quality_model.fit(table, labels)
    held = {r.doc_id: r.h for r in table.selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 10000) < 2500 AS h").collect()}
    x = np.array([quality_model.statistics(t) for _, t in docs[:400]])
    y, out = np.array([float(k % 4 > 0) for k in range(400)]), np.array([held[k] for k in range(400)])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3))
    z = quality_model.lift(x, x.mean(0), np.maximum(x.std(0), 1e-3))
    penalty = np.sqrt(np.diag([quality_model.RIDGE] * quality_model.FEATURES + [1e-9]))
    weights = np.linalg.lstsq(np.vstack([z[~out], penalty]), np.concatenate([y[~out], np.zeros(len(penalty))]), rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-6)
    bins = np.clip(((z[out] @ weights + 1) / 3 * quality_model.BINS).astype(int), 0, quality_model.BINS - 1)
    steps = np.unique(bins)
    p, n = np.array([y[out][bins == b].mean() for b in steps]), np.array([(bins == b).sum() for b in steps])
    mean = lambda a, b: np.average(p[a : b + 1], weights=n[a : b + 1])
    assert np.allclose(model.levels, [max(min(mean(a, b) for b in range(k, len(p))) for a in range(k + 1)) for k in range(len(p))])
    assert np.allclose(model.steps, steps * 3 / quality_model.BINS - 1)


def test_fit_is_near_exact_kernel_ridge(spark):
    """The Gaussian kernel itself in place of its features, on the same rows."""
    docs, table, labels = labelled(spark)
    model = quality_model.fit(table, labels)
    held = {r.doc_id: r.h for r in table.selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 10000) < 2500 AS h").collect()}
    x = np.clip((np.array([quality_model.statistics(t) for _, t in docs]) - model.mean) / model.scale, -8, 8)
    train = np.array([k for k in range(400) if not held[k]])
    gauss = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * quality_model.BANDWIDTH**2 * x.shape[1]))
    y = (train % 4 > 0).astype(float)
    dual = np.linalg.solve(gauss(x[train], x[train]) + quality_model.RIDGE * np.eye(len(train)), y - y.mean())
    exact = gauss(x[400:], x[train]) @ dual + y.mean()
    ours = model.score(np.array([quality_model.statistics(t) for _, t in docs[400:]]))
    assert np.corrcoef(exact, ours)[0, 1] > 0.97 and np.abs(exact - ours).mean() < 0.1


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(k, int(k != 7), 0) for k in range(1, 9)], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(edge, labels).count() == edge.count()
    assert quality_model.keep_good(edge, labels).columns == edge.columns
    assert quality_model.quality_scores(edge, labels.limit(0)).filter("keep AND quality_p IS NULL").count() == edge.count()
    assert quality_model.quality_scores(empty, labels).count() == 0


def plain_judge(text):
    """The rules again, in loops: limits looked up from the top, chunks cut by slices, shares of bytes."""
    if not text:
        return False, 0
    raw = text.encode()

    def outside(part, full):
        ratio = len(zstandard.compress(part, 3)) / len(part)
        if full:
            low, high = 0.28, 0.64
        else:
            low, high = next((low, high) for least, low, high in sorted(compression_rules.BANDS, reverse=True) if len(part) >= least)
        return ratio < low or ratio > high

    parts = []
    while raw[4096 * len(parts) :]:
        parts.append(raw[4096 * len(parts) : 4096 * (len(parts) + 1)])
    bad = [p for p in parts if outside(p, len(p) == 4096)]
    return not outside(raw, False) and sum(map(len, bad)) < 0.25 * len(raw), len(bad)


def test_compression_equals_an_independent_judge(spark, edge, empty):
    rng = random.Random(8)
    noise = "".join(rng.choices(string.ascii_letters + string.digits, k=9000))
    docs = [(k, prose(k, 10 + 40 * k)) for k in range(40)] + [(100 + k, junk(k)) for k in range(9)] + [(200, prose(1, 2000) + "ab" * 20_000)]
    docs += [(300 + k, prose(k, 900)[: 4096 + n] + noise[:n]) for k, n in enumerate((1, 40, 500, 1500, 3000, 4095, 5000))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for r in compression_rules.compression_report(table).join(table, "doc_id").collect():
        size = len(r.text.encode())
        assert (r.keep, r.bad_chunks) == plain_judge(r.text) and r.n_bytes == size and r.n_chunks == -(-size // 4096)
        assert abs(r.ratio - len(zstandard.compress(r.text.encode(), 3)) / size) < 0.02
        if r.doc_id < 300:
            assert r.keep == (r.doc_id < 100 or r.doc_id < 200 and (r.doc_id - 100) % 3 != 1)
    # noise at the end counts although it fills no chunk
    assert not compression_rules.judge(prose(3, 900)[:5000] + noise[:3000], zstandard.ZstdCompressor(level=3))[4]
    rows = {(r.doc_id, r.n_bytes): r for r in compression_rules.compression_report(edge).collect()}
    assert not rows[1, None].keep and not rows[2, 0].keep and rows[2, 0].ratio is None and not rows[7, 50_000].keep and rows[4, max(b for d, b in rows if d == 4)].keep
    kept = compression_rules.keep_by_compression(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {None, 3, 4, 5, 6, 8}
    assert compression_rules.compression_report(empty).count() == 0


def test_encoded_and_random_strings_are_rejected_and_prose_kept():
    packer, rng = zstandard.ZstdCompressor(level=3), random.Random(11)
    for size in (100, 150, 190, 220, 300, 600, 1000, 1500, 3000, 4096, 9000, 20_000):
        for seed in range(5):
            encoded = base64.b64encode(rng.randbytes(size)).decode()[:size]
            mixed = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
            assert not any(compression_rules.judge(t, packer)[4] for t in (encoded, mixed)), size
            assert compression_rules.judge(prose(seed, size)[:size], packer)[4], size
    assert compression_rules.judge(encoded, packer)[3] == 5
    assert not compression_rules.judge("x" * 40, packer)[4] and compression_rules.judge(prose(3, 6), packer)[4]


def brute_rules(rows, support, confidence):
    """All sets of tokens by counting."""
    import itertools

    seen, bad = Counter(), Counter()
    for tokens, is_bad in rows:
        for n in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), n):
                seen[s] += 1
                bad[s] += is_bad
    rules = {s: bad[s] / seen[s] for s in seen if bad[s] >= support and bad[s] / seen[s] >= confidence}
    return {s: c for s, c in rules.items() if not any(set(x) < set(s) and rules[x] >= c for x in rules)}


def test_rules_equal_brute_force(spark):
    rng = random.Random(5)
    urls = []
    for k in range(400):
        host, lang, q = rng.choice(["a.example.com", "b.example.net", "spam.example.org"]), rng.choice(["en", "fr"]), rng.choice(["", "?ref=x", "?page=2"])
        bad = rng.random() < (0.9 if host.startswith("spam") and q else 0.05)
        urls.append((k, f"http://{host}/{lang}/{k}{q}", bad))
    pages = spark.createDataFrame([(k, u, "<p>") for k, u, _ in urls], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, int(not b), 0) for k, _, b in urls], "doc_id long, quality int, toxic int")
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_rules.url_tokens(pages["url"]).alias("t")).collect()}
    assert tokens[0] == sorted(tokens[0]) and {"scheme:http", "seg:#"} <= set(tokens[0])
    want = brute_rules([(tokens[k], b) for k, _, b in urls], max(0.002 * 400, 5), 0.5)
    mined = url_rules.mine(url_rules.labelled_urls(pages, labels))
    assert {tuple(r.tokens): round(r.confidence, 9) for r in mined.collect()} == {s: round(c, 9) for s, c in want.items()} and want
    for r in url_rules.filter_urls(pages, labels).collect():
        met = [c for s, c in want.items() if set(s) <= set(tokens[r.page_id])]
        assert r.n_rules == len(met) and r.confidence == (max(met) if met else None) and r.blocked == bool(met)


def test_rules_are_found_where_most_labels_are_bad(spark):
    urls = [(k, f"http://{'spam' if k % 2 else 'mixed'}.example.org/{k}", k % 2 == 1 or k % 5 < 3) for k in range(200)]
    labelled = spark.createDataFrame([(u, b) for _, u, b in urls], "url string, bad boolean")
    rules = url_rules.mine(labelled)
    assert {tuple(r.tokens) for r in rules.collect()} == {("host:spam.example.org",), ("sub:spam",)}
    pages = spark.createDataFrame([(k, u) for k, u, _ in urls], "page_id long, url string")
    assert {r.page_id for r in url_rules.apply_rules(pages, rules).filter("blocked").collect()} == set(range(1, 200, 2))


def test_url_edges(spark):
    urls = [None, "", "not a url", "http://", "https://h.example.com/1?x#y", "https://h.example.com/1?x#y", "ftp://[::1]/99", "http://e.example.com/" + "a/" * 3000 + "2"]
    pages = spark.createDataFrame([(None if k == 1 else k, u, None, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, confidence string, key string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (1, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert url_rules.filter_urls(pages, labels).count() == len(urls)
    assert url_rules.filter_urls(pages, labels.limit(0)).filter("blocked").count() == 0
    assert url_rules.filter_urls(pages.limit(0), labels).count() == 0
