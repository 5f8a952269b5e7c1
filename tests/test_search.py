import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegrove.config import ChunkingConfig
from notegrove.operators import ranking, search
from notegrove.operators.chunking import chunk_texts, split_text

WORDS = ["alpha", "beta", "Gamma", "delta", "été", "naïve", "the", "of", "Ångström", "zeta_eta", "数据库", "x1"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(f"c{k:03}", f"memory/{'s/' if k % 3 == 0 else ''}n{k}.md", "s" if k % 3 == 0 else "memory", "m", 1, 2, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for k in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), "chunk_id string, path string, source string, model string, start_line int, end_line int, text string")


def ask(spark, *queries):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(queries)], "query_id string, query string")


def test_bm25_equals_sqlite(spark, chunks):
    queries = ["alpha", "alpha beta", "ete", "the of", "zeta_eta", "gamma gamma", "angstrom naive", "数据库", "missing", "alpha missing", "_", "数据"]
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text, id UNINDEXED)")
        db.executemany("INSERT INTO t(text, id) VALUES (?, ?)", [(r[6], r[0]) for r in corpus()])
        want = {}
        for k, q in enumerate(queries):
            match = " AND ".join(f'"{w}"' for w in q.split())
            want |= {(str(k), i): r for i, r in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = {(r.query_id, r.chunk_id): r.rank for r in search.bm25(search.KeywordIndex.of(chunks), ask(spark, *queries)).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_keyword_search_filters_and_limits(spark, chunks):
    queries = ask(spark, "alpha", "???", "")
    every = search.keyword_search(chunks, queries, 100)
    assert {r.query_id for r in every.collect()} == {"0"} and every.filter("score <> text_score OR vector_score IS NOT NULL OR score <= 0 OR score > 1").count() == 0
    assert search.keyword_search(chunks, queries, 2).count() == 2
    only = search.keyword_search(chunks, queries, 100, source="s")
    scores = {r.chunk_id: r.score for r in every.collect()}
    assert only.count() > 0 and all(r.source == "s" and r.score == scores[r.chunk_id] for r in only.collect())
    assert search.keyword_search(chunks, queries, 9, model="other").count() == 0
    assert search.expanded_search(chunks, ask(spark, "missing alpha"), 100).count() == every.count()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("same", [1.0, 0.0, 0.0, 0.0]), ("across", [0.0, 1.0, 0.0, 0.0]), ("against", [-1.0, 0.0, 0.0, 0.0]), ("near", [0.9, 0.1, 0.0, 0.0]), ("zero", [0.0] * 4), ("none", None), ("void", [])]
    return spark.createDataFrame([(n, f"{n}.md", "s" if n == "near" else "memory", "m", 1, 1, n, v) for n, v in rows], "chunk_id string, path string, source string, model string, start_line int, end_line int, text string, embedding array<double>")


@pytest.mark.parametrize("sent", [search.SENT_VALUES, 3])
def test_vector_search(spark, vectors, sent, monkeypatch):
    monkeypatch.setattr(search, "SENT_VALUES", sent)
    asked = spark.createDataFrame([("q", "x", [2.0, 0.0, 0.0, 0.0]), ("z", "x", [0.0] * 4)], "query_id string, query string, vec array<double>")
    got = search.vector_search(vectors, asked, 10).orderBy(F.desc("score")).collect()
    assert [r.chunk_id for r in got] == ["same", "near", "across", "against"] and [round(r.score, 6) for r in got] == [1.0, 0.993884, 0.0, -1.0]
    assert [r.chunk_id for r in search.vector_search(vectors, asked, 10, source="s").collect()] == ["near"]
    assert search.vector_search(vectors, asked, 2).count() == 2


def test_vector_search_needs_vectors(spark, vectors):
    with pytest.raises(ValueError):
        search.vector_search(vectors, spark.createDataFrame([("q", "x", None)], "query_id string, query string, vec array<double>"), 3)
    with pytest.raises(Exception, match="no vectors"):
        search.vector_search(vectors, ask(spark, "x"), 3)


CANDIDATE = "query_id string, chunk_id string, path string, source string, start_line int, end_line int, text string, score double, vector_score double, text_score double"


def rows(spark, *items):
    """(chunk_id, score, vector_score, text_score, text, path)"""
    return spark.createDataFrame([("q", i, p, "memory", 1, 2, t, float(s), v, x) for i, s, v, x, t, p in items], CANDIDATE)


def test_merge(spark):
    vec = rows(spark, ("both", 0.9, 0.9, None, "from vector", "a.md"), ("only_v", 0.9, None, None, "v", "b.md"), ("empty_text", 0.5, 0.5, None, "kept", "c.md"))
    key = rows(spark, ("both", 0.6, None, 0.6, "from keyword", "a.md"), ("only_k", 0.8, None, 0.8, "k", "d.md"), ("empty_text", 0.5, None, 0.5, "", "c.md"))
    got = {r.chunk_id: r for r in search.merge(vec, key).collect()}
    assert {k: round(r.score, 6) for k, r in got.items()} == {"both": 0.81, "only_v": 0.63, "only_k": 0.24, "empty_text": 0.5}
    assert got["both"].text == "from keyword" and got["empty_text"].text == "kept" and got["only_v"].text_score == 0 and got["only_k"].vector_score == 0
    assert [r.chunk_id for r in search.merge(vec, key, limit=2).orderBy(F.desc("score")).collect()] == ["both", "only_v"]
    assert round(search.merge(vec, key, vector_weight=0.6, text_weight=0.6).filter("chunk_id = 'both'").first().score, 6) == 0.9


def test_threshold_and_decay(spark):
    items = rows(spark, ("a", 0.5, None, None, "x", "memory/2026-01-01.md"), ("b", 0.35, None, None, "x", "MEMORY.md"), ("c", 0.34, None, None, "x", "sessions/old.md"), ("d", 0.5, None, None, "x", "memory/2027-01-01.md"))
    assert {r.chunk_id for r in ranking.threshold(items, 0.35).collect()} == {"a", "b", "d"}
    now = F.lit("2026-03-28").cast("date")
    plain = {r.chunk_id: r.score for r in ranking.temporal_decay(items, 30.0, now).collect()}
    assert plain["a"] == pytest.approx(0.5 * 0.5 ** (86 / 30)) and plain["b"] == 0.35 and plain["c"] == 0.34 and plain["d"] == 0.5
    files = spark.createDataFrame([("sessions/old.md", 1766793600.0), ("MEMORY.md", 0.0)], "path string, mtime double")
    dated = {r.chunk_id: r.score for r in ranking.temporal_decay(items, 30.0, now, files).collect()}
    assert dated["b"] == 0.35 and dated["c"] == pytest.approx(0.34 * 0.5 ** (91 / 30))


def greedy(items, lam):
    """The rule word for word, over lists."""
    import re

    items = sorted(items, key=lambda r: (-r[1], r[0]))
    lam = max(0.0, min(1.0, lam))
    sets = {i: set(re.findall("[a-z0-9_]+", t.lower())) for i, _, t in items}
    low, high = min(s for _, s, _ in items), max(s for _, s, _ in items)
    out = []
    while items:
        def value(r):
            rel = 1.0 if high == low else (r[1] - low) / (high - low)
            sims = [len(sets[r[0]] & sets[o]) / len(sets[r[0]] | sets[o]) if sets[r[0]] | sets[o] else 1.0 for o in out]
            return lam * rel - (1 - lam) * max(sims, default=0.0)

        best = max(items, key=value)
        out.append(best[0])
        items.remove(best)
    return out


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.7, 1.0, 2.0, -1.0])
def test_diversity_equals_the_rule(spark, lam):
    rng = random.Random(4)
    items = [(f"c{k}", rng.choice([0.9, 0.8, 0.5]), " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randint(0, 5)))) for k in range(14)]
    got = ranking.diversify(rows(spark, *((i, s, None, None, t, "p.md") for i, s, t in items)), lam)
    want = [i for i, s, _ in sorted(items, key=lambda r: (-r[1], r[0]))] if lam >= 1 else greedy(list(items), lam)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == want
    assert {r.chunk_id: r.score for r in got.collect()} == {i: s for i, s, _ in items}


def test_boosts(spark):
    items = rows(spark, ("a", 0.8, 0.8, None, "about nothing\nDate: 2024/02/18", "memory/s1.md"), ("b", 0.4, 0.4, None, "the Golden Gate Bridge\nDate: 2024/02/06", "memory/s2.md"), ("c", 0.2, None, None, "flight plan", "memory/s3.md"))
    named = items.withColumn("query", F.lit("When was Golden Gate Bridge closed?"))
    got = {r.chunk_id: round(r.score, 6) for r in ranking.entity_boost(named, 0.3).collect()}
    assert got == {"a": 0.8, "b": 0.55, "c": 0.2}
    liked = items.withColumn("query", F.lit("Which Golden Gate Bridge do I prefer?"))
    assert {r.chunk_id: r.score for r in ranking.entity_boost(liked, 0.3).collect()} == {"a": 0.8, "b": 0.4, "c": 0.2}
    rare = items.withColumn("query", F.lit("flight plan"))
    assert {r.chunk_id: round(r.score, 6) for r in ranking.rarity_boost(rare, 0.6).collect()} == {"a": 0.8, "b": 0.4, "c": 0.32}
    assert {r.chunk_id: round(r.score, 6) for r in ranking.rarity_boost(rare, 0.6, pairs=True).collect()} == {"a": 0.8, "b": 0.4, "c": 0.32}
    dated = items.withColumn("query", F.lit("two weeks ago")).withColumn("question_date", F.lit("2024-02-20"))
    got = {r.chunk_id: round(r.score, 6) for r in ranking.date_boost(dated, 0.4).collect()}
    assert got == {"a": 0.8, "b": 0.6, "c": 0.2}
    none = items.withColumn("query", F.lit("who")).withColumn("question_date", F.lit("x"))
    assert {r.chunk_id: r.score for r in ranking.date_boost(none, 0.4).collect()} == {"a": 0.8, "b": 0.4, "c": 0.2}


def walk(content, most, overlap):
    """Line after line with a buffer, as the chunking rule is told."""
    out, held = [], []
    size = lambda part: sum(len(s) + 1 for _, s in part)
    for number, line in enumerate(content.split("\n"), 1):
        for piece in [line[k : k + most] for k in range(0, len(line), most)] or [""]:
            if held and size(held) + len(piece) + 1 > most:
                out.append(held)
                keep = len(held)
                while overlap and keep and size(held[keep:]) < overlap:
                    keep -= 1
                held = held[keep:] if overlap else []
            held = [*held, (number, piece)]
    out.append(held)
    return [(h[0][0], h[-1][0], "\n".join(s for _, s in h)) for h in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=25), st.sampled_from([(8, 0), (8, 3), (10, 9), (20, 5), (1, 0)]))
def test_chunks_follow_the_rule(lengths, budget):
    config = ChunkingConfig(*budget)
    content = "\n".join("abcdefghij"[k % 10] * n for k, n in enumerate(lengths))
    assert split_text(content, config) == walk(content, config.max_chars, config.overlap_chars)


def test_chunk_edges(spark):
    assert split_text("", ChunkingConfig()) == [(1, 1, "")] and split_text("a\n", ChunkingConfig()) == [(1, 2, "a\n")]
    assert [(a, b) for a, b, _ in split_text("x" * 200, ChunkingConfig(8, 0))] == [(1, 1)] * 7
    texts = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.chunk_no, r.start_line, r.end_line, r.text) for r in chunk_texts(texts).orderBy("id").collect()] == [(1, 0, 1, 2, "a\nb"), (3, 0, 1, 1, "")]


def test_scores_do_not_depend_on_place_batch_or_threads():
    """Copies of a vector score alike wherever they stand, in batches of any size, with one or four BLAS threads."""
    code = """
import sys, hashlib, numpy as np
from notegrove.operators.search import best_by_product, unit_rows
rng = np.random.default_rng(5)
_, queries = unit_rows(list(rng.normal(size=(40, 64)).astype(np.float32)))
base = rng.normal(size=(300, 64)).astype(np.float32)
which = rng.integers(0, 300, 3000)
seen = {}
for size in (1, 7, 64, 999, 3000):
    order = rng.permutation(3000)
    for at in range(0, 3000, size):
        part = order[at : at + size]
        q, c, score = best_by_product(queries, unit_rows(list(base[which[part]]))[1], 20)
        for a, b, s in zip(q, which[part[c]], score):
            assert seen.setdefault((a, b), s) == s
print(hashlib.sha256(repr(sorted((int(a), int(b), float(s)) for (a, b), s in seen.items())).encode()).hexdigest())
"""
    import os
    import subprocess
    import sys

    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": n, "OPENBLAS_NUM_THREADS": n, "MKL_NUM_THREADS": n}, check=True, capture_output=True, timeout=300).stdout for n in ("1", "4")}
    assert len(said) == 1


def test_ranks_do_not_depend_on_row_order(spark):
    """Many chunks with the same few vectors and texts, stored in different ways: the same scores and ranks to the last bit."""
    rows = [(f"c{k:03d}", f"memory/{k}.md", "s", 1, 1, ["alpha beta gamma", "alpha beta", "beta gamma gamma delta"][k % 3], [float((k % 5) * j % 7 - 3) for j in range(64)]) for k in range(300)]
    table = spark.createDataFrame(rows, "chunk_id string, path string, source string, start_line int, end_line int, text string, embedding array<double>")
    asked = spark.createDataFrame([(str(q), "gamma beta alpha", [float((q + j) % 11 - 5) for j in range(64)]) for q in range(7)], "query_id string, query string, vec array<double>")
    told = []
    for stored in (table.coalesce(1), table.repartition(5), table.orderBy(F.desc("chunk_id")).coalesce(2)):
        found = ranking.rarity_boost(search.hybrid_search(stored, asked, 15).join(asked.select("query_id", "query"), "query_id"), 0.6)
        told.append(sorted(map(tuple, ranking.ranked(found).select("query_id", "rank", "chunk_id", "score", "vector_score", "text_score").collect())))
    assert told[0] == told[1] == told[2] and len(told[0]) == 105


def test_chunks_travel_in_small_batches(spark, monkeypatch):
    """No array of all of a batch's chunks: they leave the task as they fill BATCH_CHARS, with their own row's columns."""
    from notegrove.operators import chunking

    monkeypatch.setattr(chunking, "BATCH_CHARS", 50)
    texts = [(k, f"p{k}", None if k == 3 else "\n".join("line %d" % (k * 7 + j) for j in range(k * 9))) for k in range(12)]
    made = chunk_texts(spark.createDataFrame(texts, "id int, path string, text string").coalesce(1), ChunkingConfig(8, 2))
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    want = [(i, p, n, *c) for i, p, t in texts if t is not None for n, c in enumerate(split_text(t, ChunkingConfig(8, 2)))]
    assert sorted(map(tuple, made.collect())) == sorted(want) and made.columns == ["id", "path", "chunk_no", "start_line", "end_line", "text"]


def test_documents_are_spread_by_size(spark, monkeypatch):
    """A table in one row group is as many tasks as its bytes ask for."""
    from notegrove.sources import adapters

    monkeypatch.setattr(adapters, "SPLIT_BYTES", 10_000)
    made = adapters.chunks(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() > 20 and made.count() > 200


@pytest.mark.parametrize("sent", [500_000, 4])
def test_bm25_of_blocks_and_stored_postings(spark, chunks, monkeypatch, sent):
    """Ranks are the same from texts and postings, in any blocks, and the best of each query are those of the whole list."""
    monkeypatch.setattr(search, "SENT_TERMS", sent)
    monkeypatch.setattr(search, "SCORED_AT_ONCE", 7)
    asked = ask(spark, "alpha beta", "zeta_eta", "gamma gamma", "beta alpha_beta", "_ alpha", "delta", "missing")
    stored = search.KeywordIndex(search.postings(chunks), search.corpus_stats(chunks))
    for every in (True, False):
        whole = sorted(map(tuple, search.bm25(search.KeywordIndex.of(chunks), asked, every=every).collect()))
        assert whole == sorted(map(tuple, search.bm25(stored, asked, every=every).collect())) and len(whole) > 40
        best = {q: sorted((r, c) for p, c, r in whole if p == q)[:3] for q in {w[0] for w in whole}}
        got = search.keyword_scores(chunks, asked, 3, every=every).collect()
        assert {(r.query_id, r.chunk_id) for r in got} == {(q, c) for q, rows in best.items() for _, c in rows}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_what_is_found(spark, chunks):
    """Found chunks are broadcast to the texts: neither search sorts or shuffles the table."""
    rows = chunks.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))
    asked = ask(spark, "alpha").withColumn("vec", F.array(F.lit(3.0), F.lit(1.0)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (search.keyword_search(chunks, asked, 5), search.vector_search(rows, asked, 5), search.hybrid_search(rows, asked, 5)):
            last = _plan(found).split("Exchange")[0]
            assert "BroadcastHashJoin" in last and "SortMergeJoin" not in last and found.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registered_queries_write_chunks_but_no_postings(spark, tmp_path):
    """A search by vectors alone tokenises nothing, and the shared chunks hold no vectors."""
    import shutil
    from pathlib import Path

    import __spark_entry__ as entry
    from notegrove.sources import adapters

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "t")
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.iterdir())
    assert entry.queries()["knn_cosine"](spark, str(tmp_path / "t")).count() == 400
    assert sorted(p.name.split("-")[0] for p in set(base.iterdir()) - before) == ["chunks"]
    assert "embedding" not in adapters.indexed(spark, str(tmp_path / "t"))[0].columns


def test_own_strategy_reads_texts_once(spark):
    """Words are counted in one pass over the chunks, without a nested loop of chunks and queries."""
    import __spark_entry__ as entry

    assert "NestedLoop" not in _plan(entry.queries()["custom_strategy"](spark, "/root/testdata/sf0.001"))
