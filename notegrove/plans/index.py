"""What an index run does, as joins of the new and the stored state, and the snapshots it writes.

A run adds segments: folders of Parquet rows that are new in it, and the paths whose older rows no longer count. What
did not change is not written again. A log of small files, one a version, says which segments are in force; a version
counts once its log file is there, so a run that fails leaves the one before in force. All files are written through
Hadoop's file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from notegrove.config import CACHE, CHUNKS, FILES, GONE, META, POSTINGS, ChunkingConfig, StorageError
from notegrove.functions import scalar
from notegrove.operators import search
from notegrove.operators.chunking import chunk_texts
from notegrove.plans import embedders

TABLES = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "cache": CACHE, "meta": META}
#: Tables whose rows go when their path is written anew or deleted.
BY_PATH = ("files", "chunks", "postings")
SCHEMA_VERSION = "2"
CACHE_KEY = ("provider", "model", "provider_key", "hash")
#: Segments of a table from which a run writes it whole.
MOST_SEGMENTS = 16


class Snapshots:
    """Versions of the tables below one folder, a local path or a URI."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        place = self._path(f"{self.folder}/{name}")
        return [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []

    @property
    def current(self) -> int | None:
        """The version in force."""
        return max((int(n[:-5]) for n in self._listed("_log") if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def segments(self, version: int | None = None) -> dict[str, list[int]]:
        """Table -> versions whose segments are in force."""
        version = self.current if version is None else version
        if version is None:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/_log/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise StorageError(f"the log of {self.folder} is damaged at version {version}") from e
        finally:
            stream.close()

    def _rows(self, name: str, schema, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema).withColumn("v", F.lit(0))
        places = [f"{self.folder}/{name}/v={n}" for n in versions]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").schema(StructType([*schema.fields, StructField("v", IntegerType())])).parquet(*places)

    def read(self, name: str) -> DataFrame:
        """The rows of a table that are in force."""
        segments = self.segments()
        rows = self._rows(name, TABLES[name], segments.get(name, []))
        if name in BY_PATH and segments.get("gone"):
            gone = self._rows("gone", GONE, segments["gone"]).groupBy("path").agg(F.max("v").alias("gone_v"))
            rows = rows.join(gone, (rows["path"] == gone["path"]) & (F.col("v") < F.col("gone_v")), "left_anti")
        return rows.drop("v")

    def commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, gone: DataFrame | None = None) -> None:
        """Writes a version: rows added to tables, tables replaced whole, and paths whose rows of older versions go.

        Rows added for such a path count. The version before stays readable, older ones are deleted.
        """
        old, replaced = self.current, dict(replaced or {})
        before, new = self.segments(old), (old or 0) + 1
        if max((len(v) for v in before.values()), default=0) >= MOST_SEGMENTS:
            lost = gone.select("path") if gone is not None else None
            for name in BY_PATH:
                rows = self.read(name) if lost is None else self.read(name).join(lost, "path", "left_anti")
                replaced[name] = rows.unionByName(added[name].select(*rows.columns)) if name in added else rows
            replaced["cache"] = replaced.get("cache", self.read("cache").unionByName(added["cache"].select(*CACHE.names)) if "cache" in added else self.read("cache"))
            added, gone, before = {}, None, {k: v for k, v in before.items() if k != "gone"}
        after = {name: [] if name in replaced else list(before.get(name, [])) for name in (*TABLES, "gone")}
        for name, rows in [*added.items(), *replaced.items(), *([("gone", gone)] if gone is not None else [])]:
            schema = GONE if name == "gone" else TABLES[name]
            rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
            rows = rows.sortWithinPartitions("term", "chunk_id") if name == "postings" else rows
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={new}")
            after[name].append(new)
        draft, final = self._path(f"{self.folder}/_log/{new:010d}.draft"), self._path(f"{self.folder}/_log/{new:010d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise StorageError(f"version {new} of {self.folder} was written by another run")
        self._clean({k: {*after.get(k, ()), *before.get(k, ()), *(self.segments(old).get(k, ()) if old else ())} for k in after}, {old, new})

    def _clean(self, used: dict[str, set[int]], versions: set) -> None:
        """Deletes segments that neither the version in force nor the one before has, and older logs."""
        for name, numbers in used.items():
            for folder in self._listed(name):
                if folder.startswith("v=") and int(folder[2:]) not in numbers:
                    self._fs.delete(self._path(f"{self.folder}/{name}/{folder}"), True)
        for file in self._listed("_log"):
            if file.split(".")[0].isdigit() and int(file.split(".")[0]) not in versions:
                self._fs.delete(self._path(f"{self.folder}/_log/{file}"), False)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """New rows in place of the old ones with the same key; of new ones with the same key, the last by all columns."""
    order = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in new.columns if c not in keys and "array" not in dict(new.dtypes)[c]))
    last = new.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth") if len(keys) < len(new.columns) else new.distinct()
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def change_set(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): new, modified (another digest), unchanged or deleted."""
    both = disk.select("path", F.col("hash").alias("now")).join(stored.select("path", F.col("hash").alias("was")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def stale(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows whose path is gone."""
    return stored.join(disk.select("path"), "path", "left_anti")


def is_dirty(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """One row (dirty): whether paths differ or a file is newer than stored by more than a millisecond."""
    both = disk.select("path", F.col("mtime").alias("now")).join(stored.select("path", F.col("mtime").alias("was")), "path", "full_outer")
    return both.agg(F.coalesce(F.bool_or(F.col("now").isNull() | F.col("was").isNull() | (F.col("now") > F.col("was") + 1e-3)), F.lit(False)).alias("dirty"))


def new_chunks(files: DataFrame, model: str, config: ChunkingConfig | None = None) -> DataFrame:
    """Chunks of (path, source, text) with their digests and ids; of equal ids one row stays."""
    made = chunk_texts(files.select("path", "source", "text"), config).withColumn("hash", scalar.sha256(F.col("text"))).withColumn("model", F.lit(model))
    key = scalar.chunk_id(F.col("source"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("hash"), F.col("model"))
    return made.withColumn("chunk_id", key).drop("chunk_no").dropDuplicates(["chunk_id"])


def new_postings(chunks: DataFrame) -> DataFrame:
    """(path, term, chunk_id, dl, pos) of chunks."""
    return search.postings(chunks, "path")


def stored_index(chunks: DataFrame, postings: DataFrame) -> search.KeywordIndex:
    """An index of stored postings, sorted by term in each file; its statistics come from two row counts."""
    n, tokens = chunks.count(), postings.count()
    return search.KeywordIndex(postings, chunks.sparkSession.range(1).select(F.lit(n).alias("n"), F.lit(tokens / n if n else None).cast("double").alias("avgdl")))


def chunks_of(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Chunks of one path, or of all of them, with their place `nth` in the file from 1: by first line, then last line, then id."""
    rows = chunks if path is None else chunks.filter(F.col("path") == path)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "end_line", "chunk_id")))


def of_source(rows: DataFrame, source: str | None) -> DataFrame:
    """Rows of one source, or all."""
    return rows if source is None else rows.filter(F.col("source") == F.lit(source))


def cache_lookup(chunks: DataFrame, cache: DataFrame, provider: str, model: str, key: str) -> DataFrame:
    """chunks with the cached embedding of their digest, null where the cache has none."""
    own = cache.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("provider_key") == key))
    return chunks.join(own.select("hash", F.col("embedding").alias("cached"), F.lit(True).alias("hit")), "hash", "left")


def evict(cache: DataFrame, most: int | None) -> DataFrame:
    """The newest `most` entries of each provider and model; of equally old ones those with the smaller digest stay."""
    if most is None:
        return cache
    order = Window.partitionBy("provider", "model").orderBy(F.desc("updated_at"), "hash")
    return cache.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= most).drop("__nth")


def file_info(files: DataFrame, chunks: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """files with their number of chunks and whether they are evergreen by name."""
    counts = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    return files.join(counts, "path", "left").select("path", "size", "hash", "mtime", F.coalesce("chunks", F.lit(0)).alias("chunks"), scalar.evergreen_name(F.col("path"), patterns).alias("is_evergreen"), "source")


def fingerprint(model: str, key: str, config: ChunkingConfig) -> str:
    """What chunks depend on besides the files."""
    import json

    return json.dumps({"model": model, "provider_key": key, "chunk_tokens": config.tokens, "chunk_overlap": config.overlap}, sort_keys=True)


def embed_missing(chunks: DataFrame, cache: DataFrame, provider, key: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with embeddings, and the cache rows of those that were computed: each distinct digest once.

    The third is what is kept so that nothing is embedded twice; the caller lets go of it.
    """
    seen = cache_lookup(chunks, cache, provider.name, provider.model, key)
    missing = seen.filter("hit IS NULL").groupBy("hash").agg(F.first("text").alias("text"))
    made = embedders.embed(missing, provider).persist()
    rows = made.filter("embedding IS NOT NULL").select(F.lit(provider.name).alias("provider"), F.lit(provider.model).alias("model"), F.lit(key).alias("provider_key"), "hash", "embedding", F.size("embedding").alias("dims"), F.lit(now).cast("long").alias("updated_at"))
    whole = seen.join(made, "hash", "left").withColumn("embedding", F.coalesce("cached", "embedding")).drop("cached", "hit")
    return whole, rows, made


