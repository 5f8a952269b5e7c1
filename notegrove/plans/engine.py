"""The engine: index, search, status, flush and watch over a workspace, with registries for own strategies and steps."""

from __future__ import annotations

import datetime
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.config import EngineConfig, FlushError, GroveError, IndexError_, SearchError, StrategyError, VectorsUnavailable
from notegrove.functions import scalar
from notegrove.operators import ranking, search
from notegrove.plans import index
from notegrove.plans.embedders import EmbeddingProvider, HashEmbedder, HttpExtractor, embed
from notegrove.sources import files
from notegrove.sources.shared import kept

log = logging.getLogger("notegrove")
FINGERPRINT, SILENT = "provider_fingerprint", "NO_REPLY"
EXTRACT = "Note down, as short Markdown, whatever of this conversation will matter after YYYY-MM-DD. Answer NO_REPLY if nothing does."


@dataclass
class IndexResult:
    files_scanned: int = 0
    files_indexed: int = 0
    files_skipped: int = 0
    files_deleted: int = 0
    chunks_created: int = 0
    embeddings_cached: int = 0
    embeddings_computed: int = 0
    duration_ms: float = 0.0


@dataclass(frozen=True)
class SearchContext:
    """What a strategy gets: all chunks, the batch of queries, how many candidates, and a source to keep to."""

    chunks: DataFrame
    queries: DataFrame
    limit: int
    source: str | None = None


Strategy = Callable[[SearchContext], DataFrame]
Step = Callable[[DataFrame, dict], DataFrame]


class Engine:
    """Not thread-safe. Opens at first use; `close` stops a running watch.

    With a corpus, a table of chunks and its keyword index, it searches that and has no workspace to index.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, provider: EmbeddingProvider | None = None, corpus: tuple[DataFrame, search.KeywordIndex] | None = None) -> None:
        self.spark, self.config = spark, config or EngineConfig()
        self.workspace = os.path.abspath(self.config.workspace_dir)
        folder = self.config.snapshot_dir or os.path.join(self.workspace, files.OWN_FOLDER)
        self.folder = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
        self.corpus = corpus
        self.provider = provider if provider is not None else HashEmbedder() if self.config.vectors else None
        self.snapshots = index.Snapshots(spark, self.folder)
        self.strategies: dict[str, Strategy] = {}
        self.steps: list[Step] = []
        self.watch = None
        self._dirty: bool | None = None

    def __repr__(self) -> str:
        return f"Engine({self.workspace!r}, provider={self.provider.name if self.provider else None}, version={self.snapshots.current})"

    def __enter__(self) -> Engine:
        return self.open()

    def __exit__(self, *_: object) -> None:
        self.close()

    def open(self) -> Engine:
        if self.corpus is not None:
            self._dirty = False
        if self._dirty is None:
            try:
                self._dirty = bool(index.is_dirty(self._disk(), self.table("files")).first()[0])
            except Exception:
                log.warning("the state of the workspace is unknown", exc_info=True)
                self._dirty = True
        return self

    def close(self) -> None:
        self.stop_watching()

    @property
    def dirty(self) -> bool:
        self.open()
        return bool(self._dirty)

    def table(self, name: str) -> DataFrame:
        return self.snapshots.read(name)

    def create_views(self) -> None:
        """files, chunks, postings, embedding_cache and meta as views for SQL."""
        for name in index.TABLES:
            self.table(name).createOrReplaceTempView("embedding_cache" if name == "cache" else name)

    def _disk(self) -> DataFrame:
        return files.list_workspace(self.spark, self.workspace, self.config.extra_paths)

    @property
    def _key(self) -> str:
        p = self.provider
        return self.spark.range(1).select(scalar.provider_key(F.lit(p.name), F.lit(p.model), F.lit(p.api_base).cast("string"))).first()[0] if p else ""

    @property
    def _model(self) -> str:
        return self.provider.model if self.provider else "none"

    # --- indexing -----------------------------------------------------------------------------------------------

    def index(self, force: bool = False) -> IndexResult:
        """Brings the snapshot up to date with the workspace; force does so for unchanged files too."""
        self.open()
        print_now = index.fingerprint(self._model, self._key, self.config.chunking)
        known = self.table("meta").filter(F.col("key") == FINGERPRINT).select("value").first()
        return self._run(self._disk(), force or (known is not None and known[0] != print_now), prune=True, meta=print_now)

    def add(self, path: str, force: bool = False) -> IndexResult:
        """Indexes one file, relative to the workspace or absolute."""
        self.open()
        whole = path if os.path.isabs(path) else os.path.join(self.workspace, path)
        if not os.path.isfile(whole):
            raise IndexError_(f"no such file: {path}")
        disk = files.list_workspace(self.spark, self.workspace, (*self.config.extra_paths, whole)).filter(F.col("abs_path") == os.path.abspath(whole))
        return self._run(disk, force, prune=False, meta=None)

    def _run(self, disk: DataFrame, force: bool, prune: bool, meta: str | None) -> IndexResult:
        began, now = time.time(), int(time.time())
        disk = disk.persist()
        kept = [disk]
        try:
            stored, cache, added, replaced = self.table("files"), self.table("cache"), {}, {}
            changes = index.change_set(disk, stored).persist()
            kept.append(changes)
            count = dict(changes.groupBy("change").count().collect())
            count.pop("deleted", None) if not prune else None
            wanted = changes.filter(F.col("change") != "deleted") if force else changes.filter(F.col("change").isin("new", "modified"))
            gone = changes.filter(F.col("change") == "deleted") if prune else changes.limit(0)
            fresh = disk.join(wanted.select("path"), "path", "left_semi")
            chunks = index.new_chunks(fresh, self._model, self.config.chunking).persist()
            kept.append(chunks)
            made = chunks.count()
            cached = computed = 0
            if self.provider:
                base = cache if self.config.cache.enabled else cache.limit(0)
                chunks, rows, embedded = index.embed_missing(chunks, base, self.provider, self._key, now)
                kept.append(embedded)
                hits = index.cache_lookup(chunks.drop("embedding"), base, self.provider.name, self.provider.model, self._key)
                cached = hits.filter("hit").select("hash").distinct().count()
                computed = rows.count()
                if self.config.cache.enabled:
                    most = self.config.cache.max_entries
                    if most is not None and computed and cache.count() + computed > most:
                        replaced["cache"] = index.evict(index.upsert(cache, rows, index.CACHE_KEY), most)
                    elif computed:
                        added["cache"] = rows
            else:
                chunks = chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
            if not wanted.isEmpty():
                added["files"] = fresh.select("path", "source", "hash", "mtime", "size")
                added["chunks"] = chunks.withColumn("updated_at", F.lit(now).cast("long")).withColumn("embedding", scalar.as_float32(F.col("embedding")))
                added["postings"] = index.new_postings(chunks)
            touched = wanted.select("path").union(gone.select("path")).join(stored.select("path"), "path", "left_semi")
            if meta is not None:
                rows = self.spark.createDataFrame([(FINGERPRINT, meta), ("schema_version", index.SCHEMA_VERSION)], index.META)
                replaced["meta"] = index.upsert(self.table("meta"), rows, ["key"])
            self.snapshots.commit(added, replaced, None if touched.isEmpty() else touched)
        except GroveError:
            raise
        except Exception as e:
            raise IndexError_(str(e)) from e
        finally:
            for df in kept:
                df.unpersist()
        self._dirty = False
        scanned = sum(v for k, v in count.items() if k != "deleted")
        done = scanned if force else count.get("new", 0) + count.get("modified", 0)
        return IndexResult(scanned, done, scanned - done, count.get("deleted", 0), made, cached, computed, (time.time() - began) * 1000)

    # --- search -------------------------------------------------------------------------------------------------

    def register_strategy(self, name: str, strategy: Strategy) -> None:
        """A search of one's own; a built-in name is shadowed."""
        if not callable(strategy):
            raise StrategyError(f"{name} can't be called")
        self.strategies[name] = strategy

    def register_step(self, step: Step) -> None:
        """A step after all others, in order of registration: (candidates, settings) -> candidates."""
        self.steps.append(step)

    def search(self, query: str, **settings) -> DataFrame:
        """Results of one query; see search_many."""
        return self.search_many(self.spark.createDataFrame([("q", query)], "query_id string, query string"), **settings)

    def search_many(self, queries: DataFrame, **settings) -> DataFrame:
        """Ranked results (config.RESULTS) of a batch of queries (query_id, query).

        settings: max_results, min_score, strategy, source, mmr_lambda, decay_half_life_days, now (a date), and
        whatever own steps take. The threshold comes before decay, so decayed scores can lie below it.
        """
        self.open()
        if self.config.sync.on_search and self._dirty:
            try:
                self.index()
            except GroveError:
                log.warning("the workspace could not be synchronised", exc_info=True)
        q = self.config.query
        most = settings.get("max_results") or q.max_results
        least = q.min_score if settings.get("min_score") is None else settings["min_score"]
        try:
            found = self._candidates(queries, settings.get("strategy") or q.strategy, most * q.hybrid.candidate_multiplier, settings.get("source"))
            found = ranking.threshold(found, least)
            half_life = settings.get("decay_half_life_days")
            if q.temporal_decay.enabled or half_life is not None:
                now = F.lit(settings.get("now") or datetime.date.today()).cast("date")
                found = ranking.temporal_decay(found, q.temporal_decay.half_life_days if half_life is None else half_life, now, self.table("files") if self.corpus is None else None)
            lam = settings.get("mmr_lambda")
            if q.mmr.enabled or lam is not None:
                found = ranking.diversify(found, q.mmr.lambda_param if lam is None else lam)
            else:
                found = ranking.ranked(found)
            for step in self.steps:
                found = step(found.join(queries.select("query_id", "query"), "query_id", "left") if "query" not in found.columns else found, settings)
            if "rank" not in found.columns:
                found = ranking.ranked(found)
            return ranking.results(ranking.cut(found, most), q.snippet_max_chars).orderBy("query_id", "rank")
        except GroveError:
            raise
        except Exception as e:
            raise SearchError(str(e)) from e

    def _candidates(self, queries: DataFrame, name: str, limit: int, source: str | None) -> DataFrame:
        hybrid = self.config.query.hybrid
        chunks = self.table("chunks") if self.corpus is None else self.corpus[0]
        if name in self.strategies:
            return self.strategies[name](SearchContext(chunks, queries, limit, source))
        if name not in ("keyword", "vector", "hybrid"):
            raise StrategyError(f"no strategy is called {name}")
        filters = {"model": self._model, "source": source}
        words = index.stored_index(chunks, self.table("postings")) if self.corpus is None and name != "vector" else self.corpus and self.corpus[1]
        if name == "keyword" or (name == "hybrid" and self.provider is None):
            return search.keyword_search(chunks, queries, limit, index=words, **filters)
        if self.provider is None:
            raise VectorsUnavailable("vectors are switched off")
        texts = queries.select(F.col("query").alias("text")).distinct().withColumn("hash", scalar.sha256(F.col("text")))
        vectors = kept(embed(texts, self.provider).withColumnRenamed("embedding", "vec"), "queries")  # one call a text
        asked = queries.withColumn("hash", scalar.sha256(F.col("query"))).join(vectors, "hash").select("query_id", "query", "vec")
        if name == "vector":
            return search.vector_search(chunks, asked, limit, **filters)
        return search.hybrid_search(chunks, asked, limit, index=words, vector_weight=hybrid.vector_weight, text_weight=hybrid.text_weight, **filters)

    # --- the rest -----------------------------------------------------------------------------------------------

    def files(self, source: str | None = None) -> DataFrame:
        """One row a file, of one source or all: path, size, hash, mtime, chunks, is_evergreen, source."""
        self.open()
        return index.file_info(index.of_source(self.table("files"), source), self.table("chunks"), self.config.evergreen_patterns).orderBy("path")

    def chunks(self, path: str) -> DataFrame:
        """A file's chunks from top to bottom."""
        return index.chunks_of(self.table("chunks"), path).orderBy("nth")

    def status(self) -> dict:
        self.open()
        return {
            "files": self.table("files").count(), "chunks": self.table("chunks").count(), "dirty": self.dirty, "workspace_dir": self.workspace, "snapshot_dir": self.folder,
            "search_mode": "hybrid" if self.provider else "keyword", "provider": self.provider.name if self.provider else "none", "model": self.provider.model if self.provider else None,
            "keyword_available": True, "vector_available": self.provider is not None, "cache_entries": self.table("cache").count(), "cache_max_entries": self.config.cache.max_entries, "watching": self.watch is not None,
        }

    def clear_cache(self) -> int:
        """Drops all cached embeddings; how many there were."""
        n = self.table("cache").count()
        self.snapshots.commit({}, {"cache": self.spark.createDataFrame([], index.CACHE)})
        return n

    def flush(self, conversation: list[dict], extract: Callable[[list[dict]], str | None] | None = None, system_prompt: str | None = None, today: datetime.date | None = None) -> str | None:
        """Appends what `extract` makes of a conversation to today's note and indexes it; None if that is nothing.

        extract gets the messages with a system prompt before them, in which YYYY-MM-DD has become today's date; a chat
        service (config.flush) if it is None. Flushing that is switched off appends nothing.
        """
        if not self.config.flush.enabled:
            return None
        extract = extract or HttpExtractor(self.config.flush)
        day = (today or datetime.date.today()).isoformat()
        prompt = (system_prompt or self.config.flush.system_prompt or EXTRACT).replace("YYYY-MM-DD", day)
        try:
            said = extract([{"role": "system", "content": prompt}, *conversation])
        except Exception as e:
            raise FlushError(str(e)) from e
        if not said or not said.strip() or said.strip() == SILENT:
            return None
        note = os.path.join(self.workspace, "memory", f"{day}.md")
        files.append_note(note, said.strip())
        self.add(note, force=True)
        return said.strip()

    def start_watching(self) -> None:
        """Indexes whenever files change, as a stream; does nothing if that runs already."""
        from notegrove.streaming.watch import watch_workspace

        self.open()
        if self.watch is None:
            self.watch = watch_workspace(self.spark, self.workspace, lambda: self.index(), self.config.sync.watch_debounce_ms, checkpoint=f"{self.folder}/_watch")

    def stop_watching(self) -> None:
        if self.watch is not None:
            self.watch.stop()
            self.watch = None

    def with_query(self, **changes) -> Engine:
        """An engine over the same snapshots with other query settings."""
        other = Engine(self.spark, replace(self.config, query=replace(self.config.query, **changes)), self.provider, self.corpus)
        other.strategies, other.steps = dict(self.strategies), list(self.steps)
        return other
