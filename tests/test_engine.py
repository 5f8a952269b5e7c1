import dataclasses
import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from notegrove import cli
from notegrove.config import ConfigError, EmbeddingConfig, EngineConfig, FlushConfig, FlushError, HybridConfig, IndexError_, QueryConfig, StorageError, StrategyError, SyncConfig, VectorsUnavailable, ChunkingConfig
from notegrove.operators import evaluate, ranking, search
from notegrove.plans import embedders, index
from notegrove.plans.embedders import CodePointEmbedder, HashEmbedder
from notegrove.plans.engine import Engine
from notegrove.sources import files
from notegrove.streaming.watch import debounce, watch_workspace


def write(root, **notes):
    for name, body in notes.items():
        path = root / "memory" / (name.replace("__", "/") + ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def ws(tmp_path):
    write(tmp_path, notes="We chose PostgreSQL for billing.\nIt is fast.", sessions__talk="The launch of the rocket is in May.", cats="Cats sleep most of the day.")
    return tmp_path


def test_listing(spark, ws):
    write(ws, bad=b"caf\xff\r\nx\ry", **{".notegrove__own": "no", "a b+c%20": "odd name"})
    (ws / "extra.md").write_text("extra")
    (ws / "extra.txt").write_text("no")
    got = {r.path: r for r in files.list_workspace(spark, str(ws), ("extra.md", "extra.txt", "missing", "memory/cats.md")).collect()}
    assert set(got) == {"extra.md", "memory/a b+c%20.md", "memory/bad.md", "memory/cats.md", "memory/notes.md", "memory/sessions/talk.md"}
    assert got["memory/bad.md"].text == "caf�\nx\ny" and got["extra.md"].source == "external" and got["memory/sessions/talk.md"].source == "sessions"
    entry = files.file_entry(str(ws / "memory" / "bad.md"))
    assert entry["hash"] == got["memory/bad.md"].hash and entry["size"] == got["memory/bad.md"].size and abs(entry["mtime"] - got["memory/bad.md"].mtime) < 0.01
    assert files.list_workspace(spark, str(ws / "nowhere")).count() == 0
    assert files.is_watched("a/b.md") and not files.is_watched("a/.notegrove/b.md") and not files.is_watched("a.txt")


def test_index_life(spark, ws):
    with Engine(spark, EngineConfig(workspace_dir=str(ws))) as engine:
        assert engine.dirty
        first = engine.index()
        assert (first.files_scanned, first.files_indexed, first.files_skipped, first.chunks_created, first.embeddings_computed) == (3, 3, 0, 3, 3)
        again = engine.index()
        assert (again.files_indexed, again.files_skipped, again.chunks_created) == (0, 3, 0) and not engine.dirty
        write(ws, cats="Dogs bark.", more="New note.")
        os.remove(ws / "memory" / "notes.md")
        third = engine.index()
        assert (third.files_scanned, third.files_indexed, third.files_skipped, third.files_deleted) == (3, 2, 1, 1)
        assert {r.path for r in engine.table("chunks").collect()} == {"memory/cats.md", "memory/more.md", "memory/sessions/talk.md"}
        forced = engine.index(force=True)
        assert forced.files_indexed == 3 and forced.embeddings_computed == 0 and forced.embeddings_cached == 3
        assert engine.table("cache").count() == 5 and engine.clear_cache() == 5 and engine.table("cache").count() == 0
        write(ws, added="Added later.")
        assert engine.add("memory/added.md").files_indexed == 1
        with pytest.raises(IndexError_):
            engine.add("memory/none.md")
        status = engine.status()
        assert (status["files"], status["chunks"], status["search_mode"]) == (4, 4, "hybrid")
        assert {r.path: (r.chunks, r.is_evergreen) for r in engine.files().collect()}["memory/added.md"] == (1, True)
    later = Engine(spark, EngineConfig(workspace_dir=str(ws)))
    assert not later.dirty
    os.utime(ws / "memory" / "added.md", (time.time() + 10, time.time() + 10))
    assert Engine(spark, EngineConfig(workspace_dir=str(ws))).dirty
    other = Engine(spark, EngineConfig(workspace_dir=str(ws), chunking=ChunkingConfig(50, 5)))
    assert other.index().files_indexed == 4


def test_search_strategies(spark, ws):
    engine = Engine(spark, EngineConfig(workspace_dir=str(ws)))
    found = engine.search("PostgreSQL billing", min_score=0.0).collect()
    assert found[0].path == "memory/notes.md" and found[0].rank == 1 and found[0].vector_score > 0
    assert [r.path for r in engine.search("rocket launch", strategy="keyword", min_score=0.0).collect()] == ["memory/sessions/talk.md"]
    assert engine.search("rocket", strategy="keyword", min_score=0.0, source="memory").count() == 0
    assert engine.search("cats", strategy="vector", min_score=-1.0, max_results=2).count() == 2
    with pytest.raises(StrategyError):
        engine.search("x", strategy="nothing")
    many = spark.createDataFrame([("1", "cats"), ("2", "rocket")], "query_id string, query string")
    assert {(r.query_id, r.path) for r in engine.search_many(many, max_results=1, min_score=0.0).collect()} == {("1", "memory/cats.md"), ("2", "memory/sessions/talk.md")}
    engine.register_strategy("fixed", lambda c: search.top(c.chunks.crossJoin(c.queries.select("query_id")).withColumn("score", F.lit(0.5)).withColumn("vector_score", F.lit(None).cast("double")).withColumn("text_score", F.lit(None).cast("double")), c.limit))
    assert engine.search("x", strategy="fixed").count() == 3
    engine.register_step(lambda df, s: ranking.one_per_path(df).filter(F.col("path") != "memory/cats.md"))
    assert engine.search("x", strategy="fixed").count() == 2
    dark = Engine(spark, EngineConfig(workspace_dir=str(ws), vectors=False, snapshot_dir=str(ws / "other")))
    with pytest.raises(VectorsUnavailable):
        dark.search("x", strategy="vector")
    assert dark.search("rocket", min_score=0.0).count() == 1


def test_decay_and_diversity_by_call(spark, ws):
    write(ws, **{"2020-01-01": "rocket rocket launch", "2026-01-01": "rocket rocket launch"})
    engine = Engine(spark, EngineConfig(workspace_dir=str(ws)))
    found = engine.search("rocket", strategy="vector", min_score=0.1, decay_half_life_days=30, now="2026-01-01").collect()
    assert found[0].path == "memory/2026-01-01.md" and min(r.score for r in found) < 0.1
    varied = engine.search("rocket", strategy="vector", min_score=0.1, mmr_lambda=0.0).collect()
    assert [r.rank for r in varied] == list(range(1, len(varied) + 1)) and varied[1].path == "memory/sessions/talk.md"


def test_flush(spark, ws):
    engine, day, seen = Engine(spark, EngineConfig(workspace_dir=str(ws))), datetime.date(2026, 3, 4), []

    def extract(messages):
        seen.append(messages)
        return "Something to keep"

    assert engine.flush([{"role": "user", "content": "hi"}], extract, today=day) == "Something to keep"
    assert "2026-03-04" in seen[0][0]["content"] and "YYYY" not in seen[0][0]["content"]
    assert engine.flush([], lambda m: "  More ", today=day) == "More"
    assert (ws / "memory" / "2026-03-04.md").read_text() == "Something to keep\n\n\nMore\n"
    assert engine.flush([], lambda m: "NO_REPLY", today=day) is None and engine.flush([], lambda m: " ", today=day) is None
    with pytest.raises(FlushError):
        engine.flush([], lambda m: 1 / 0, today=day)
    assert engine.table("files").filter("path = 'memory/2026-03-04.md'").count() == 1


def test_cache_eviction_and_upsert(spark):
    rows = spark.createDataFrame([("p", "m", "k", f"h{k}", [1.0], 1, k // 2) for k in range(6)] + [("q", "m", "k", "h0", [1.0], 1, 0)], index.CACHE)
    assert sorted(r.hash for r in index.evict(rows, 3).filter("provider = 'p'").collect()) == ["h2", "h4", "h5"]
    assert index.evict(rows, None).count() == 7 and index.evict(rows, 99).count() == 7
    new = spark.createDataFrame([("p", "m", "k", "h0", [2.0], 1, 9), ("p", "m", "k", "h9", [2.0], 1, 9), ("p", "m", "k", "h9", [3.0], 1, 10)], index.CACHE)
    after = {(r.provider, r.hash): (r.embedding[0], r.updated_at) for r in index.upsert(rows, new, index.CACHE_KEY).collect()}
    assert len(after) == 8 and after["p", "h0"] == (2.0, 9) and after["p", "h9"] == (3.0, 10) and after["q", "h0"] == (1.0, 0)


def test_snapshots_survive_a_failed_write(spark, tmp_path):
    shots = index.Snapshots(spark, str(tmp_path))
    assert shots.current is None and shots.read("files").count() == 0
    shots.commit({"meta": spark.createDataFrame([("a", "1")], index.META)})
    with pytest.raises(Exception):
        shots.commit({}, {"meta": spark.createDataFrame([("a", "2")], index.META).select(F.raise_error("no").alias("key"), "value")})
    assert shots.current == 1 and [tuple(r) for r in shots.read("meta").collect()] == [("a", "1")]
    shots.commit({})
    assert shots.current == 2 and shots.read("meta").count() == 1
    (tmp_path / "_log" / "0000000003.json").write_text("{")
    with pytest.raises(StorageError):
        shots.read("meta")


def test_snapshots_add_segments_and_drop_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 4)
    shots = index.Snapshots(spark, f"file://{tmp_path}/deep/er")
    rows = lambda *paths: {"files": spark.createDataFrame([(p, "s", h, 0.0, 1) for p, h in paths], index.FILES)}
    gone = lambda *paths: spark.createDataFrame([(p,) for p in paths], index.GONE)
    state = lambda: {r.path: r.hash for r in shots.read("files").collect()}
    shots.commit(rows(("a", "1"), ("b", "1")))
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "deep" / "er" / "files").rglob("*.parquet")}
    shots.commit(rows(("a", "2"), ("c", "1")), gone=gone("a"))
    assert state() == {"a": "2", "b": "1", "c": "1"} and all(p.stat().st_mtime_ns == t for p, t in written.items())
    shots.commit({}, gone=gone("b", "none"))
    shots.commit(rows(("b", "3")))
    assert state() == {"a": "2", "b": "3", "c": "1"}
    shots.commit(rows(("d", "1")), gone=gone("c"))
    assert len(shots.segments()["files"]) == 4
    shots.commit(rows(("a", "4")), gone=gone("a"))  # all is written whole again
    assert shots.segments()["files"] == [6] and not shots.segments()["gone"] and state() == {"a": "4", "b": "3", "d": "1"}
    shots.commit({})
    assert {p.name for p in (tmp_path / "deep" / "er" / "files").iterdir()} == {"v=6"}


def test_stored_postings_equal_those_made_anew(spark, ws):
    engine = Engine(spark, EngineConfig(workspace_dir=str(ws)))
    engine.index()
    write(ws, cats="Dogs bark at cats, cats sleep.")
    engine.index()
    chunks = engine.table("chunks")
    stored, fresh = index.stored_index(chunks, engine.table("postings")), search.KeywordIndex.of(chunks)
    assert sorted(map(tuple, stored.postings.select("term", "chunk_id", "dl", "pos").collect())) == sorted(map(tuple, fresh.postings.collect()))
    assert stored.stats.first().asDict() == fresh.stats.first().asDict()
    assert [r.nth for r in engine.chunks("memory/cats.md").collect()] == [1] and engine.chunks("none").count() == 0
    assert [r.path for r in engine.files("sessions").collect()] == ["memory/sessions/talk.md"] and engine.files("it's \\ odd").count() == 0


def test_services(ws, spark):
    """Embeddings in batches, several under way, and flushing, against a service on this machine."""
    import http.server
    import threading

    seen, lock, now, most = [], threading.Lock(), [0], [0]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen.append((self.path, self.headers.get("Authorization"), body))
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            out = {"data": [{"embedding": [len(t), 1.0]} for t in body["input"]]} if "input" in body else {"choices": [{"message": {"content": "Kept."}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1/"
    embedder = embedders.HttpEmbedder(EmbeddingConfig(model="m", api_base=base, api_key="key", batch_size=2, concurrency=3))
    texts = ["x" * k for k in range(1, 12)]
    got = embedder.embed_batch(texts)
    assert [round(v[0] / v[1]) for v in got] == [len(t) for t in texts] and 1 < most[0] <= 3
    assert len(seen) == 6 and all(p == "/v1/embeddings" and a == "Bearer key" and len(b["input"]) <= 2 for p, a, b in seen)
    assert list(embedders.batched([1, 2, 3], 2)) == [[1, 2], [3]] and embedders.gathered([lambda: 1, lambda: 2], 5) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        embedders.gathered([lambda: 1, lambda: 1 / 0, lambda: 3], 2)
    flush = FlushConfig(model="chat", max_tokens=9, temperature=0.5, api_base=base)
    engine = Engine(spark, EngineConfig(workspace_dir=str(ws), flush=flush))
    assert engine.flush([{"role": "user", "content": "hi"}], today=datetime.date(2026, 5, 6)) == "Kept."
    path, _, body = seen[-1]
    assert path == "/v1/chat/completions" and (body["model"], body["max_tokens"], body["temperature"]) == ("chat", 9, 0.5) and body["messages"][1]["content"] == "hi"
    off = Engine(spark, EngineConfig(workspace_dir=str(ws), flush=FlushConfig(enabled=False)))
    assert off.flush([{"role": "user", "content": "hi"}]) is None and "version=" in repr(engine)
    server.shutdown()


def test_embedders(spark):
    with pytest.raises(embedders.EmbeddingError):
        embedders.with_retries(lambda: 1 / 0, sleep=lambda s: None)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 busy")
        return [1]

    assert embedders.with_retries(flaky, sleep=lambda s: None) == [1] and len(calls) == 3

    def wrong():
        calls.append(1)
        raise RuntimeError("400 bad request")

    calls.clear()
    with pytest.raises(embedders.EmbeddingError):
        embedders.with_retries(wrong, sleep=lambda s: None)
    assert len(calls) == 1

    class Short(CodePointEmbedder):
        def embed_batch(self, texts):
            if any(len(t) > 150 for t in texts):
                raise RuntimeError("too long")
            return super().embed_batch(texts)

    assert embedders.with_halving(Short(), "word " * 50) is not None and embedders.with_halving(Short(), "x" * 151) is not None
    assert abs(sum(x * x for x in HashEmbedder().embed_query("some words here")) - 1) < 1e-9
    assert isinstance(HashEmbedder(), embedders.EmbeddingProvider)
    got = embedders.embed(spark.createDataFrame([("h", "abc"), ("i", "y" * 400)], "hash string, text string"), Short()).collect()
    assert len(got) == 2 and all(len(r.embedding) == 8 for r in got)


def test_config():
    config = EngineConfig(query=QueryConfig(max_results=9, hybrid=HybridConfig(0.5, 0.5)))
    assert EngineConfig.from_dict(json.loads(json.dumps(config.to_dict()))) == config
    for bad in (lambda: HybridConfig(0.5, 0.6), lambda: ChunkingConfig(10, 10), lambda: QueryConfig(max_results=0), lambda: EngineConfig(timezone="Mars/Base"), lambda: EngineConfig.from_dict({"x": 1})):
        with pytest.raises(ConfigError):
            bad()


def test_command_line(spark, ws, capsys):
    run = lambda *a: cli.main([*a, "-w", str(ws)], spark)
    assert run("index") == 0 and "files_indexed: 3" in capsys.readouterr().out
    assert run("files", "--source", "sessions") == 0 and "memory/sessions/talk.md" in capsys.readouterr().out
    assert run("search", "rocket", "--json", "--min-score", "0") == 0 and json.loads(capsys.readouterr().out)[0]["path"] == "memory/sessions/talk.md"
    assert run("search", "zzz", "--strategy", "keyword") == 0 and "No results." in capsys.readouterr().out
    assert run("stats") == 0 and "files: 3" in capsys.readouterr().out
    assert run("add", str(ws / "none.md")) == 1 and "no such file" in capsys.readouterr().err


def test_watch_and_debounce(spark, ws):
    engine = Engine(spark, EngineConfig(workspace_dir=str(ws), sync=SyncConfig(on_search=False)))
    watch_workspace(spark, str(ws), engine.index, once=True).awaitTermination()
    assert engine.table("files").count() == 3
    engine.start_watching()
    engine.start_watching()
    engine.stop_watching()
    assert engine.watch is None
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(9)), ("b", at(0))], "path string, ts timestamp")
    assert sorted((r.path, r.changes) for r in debounce(events, 1500).collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_evaluation(spark):
    ranks = spark.createDataFrame([("q1", "memory/s1.md", 1), ("q1", "memory/s2.md", 2), ("q1", "memory/s1.md", 3), ("q1", "memory/s3.md", 4), ("q2", "memory/s9.md", 1)], "query_id string, path string, rank int")
    sessions = evaluate.session_ranking(ranks)
    assert sorted((r.query_id, r.session_id, r.rank) for r in sessions.collect()) == [("q1", "s1", 1), ("q1", "s2", 2), ("q1", "s3", 3), ("q2", "s9", 1)]
    answers = spark.createDataFrame([("q1", "s2"), ("q1", "s3"), ("q1", "s8"), ("q2", "s0")], "query_id string, session_id string")
    got = {r.query_id: r for r in evaluate.per_query(sessions, answers).collect()}
    assert (got["q1"].recall_1, got["q1"].recall_3, got["q2"].recall_25) == (0.0, 1.0, 0.0)
    from math import log2

    assert got["q1"].ndcg_3 == round((1 / log2(3) + 1 / log2(4)) / (1 + 1 / log2(3)), 4) and got["q2"].ndcg_3 == 0.0
    split = evaluate.stratified_split(spark.createDataFrame([(f"i{k}", "ab"[k % 3 > 0]) for k in range(100)], "question_id string, question_type string"), 50, 7)
    assert {(r.question_type, r.part): r["count"] for r in split.groupBy("question_type", "part").count().collect()} == {("a", "dev"): 17, ("a", "held_out"): 17, ("b", "dev"): 33, ("b", "held_out"): 33}
    assert evaluate.alpha_grid(spark).count() == 27


def test_session_notes(spark):
    turns = spark.createDataFrame([("s", "2024/01/02", 1, "user", "b"), ("s", "2024/01/02", 0, "user", "a"), ("s", "2024/01/02", 2, "assistant", "no"), ("t", "2024/01/02", 0, "assistant", "no")], "session_id string, date string, turn int, role string, text string")
    assert [tuple(r) for r in files.session_notes(turns).collect()] == [("s", "# Session: s\nDate: 2024/01/02\n\na\n\nb")]


def test_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": "1", "question": "x"}, {"question_id": "2", "question": "y"}]))
    (tmp_path / "s.json").write_text(json.dumps({"dev": ["1"], "held_out": ["2"], "seed": 1}))
    split = files.read_split(spark, str(tmp_path / "s.json"))
    assert files.read_questions(spark, str(tmp_path / "q.json"), split.filter("part = 'dev'")).count() == 1
    files.write_results(split, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert dataclasses.is_dataclass(EngineConfig)
