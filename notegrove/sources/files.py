"""Workspaces of Markdown files: listing, fingerprints and texts; session notes, JSON readers and writers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.functions import scalar

#: Folder of the engine's own files; nothing below such a folder is listed.
OWN_FOLDER = ".notegrove"


def _local(path: Column) -> Column:
    """A file URL as a plain path."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _places(workspace: str, extra: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Folders and single files to list; those that don't exist are passed over."""
    roots = [os.path.join(workspace, "memory")]
    files = []
    for path in extra:
        whole = path if os.path.isabs(path) else os.path.join(workspace, path)
        if whole.endswith(".md") and os.path.isfile(whole):
            files.append(whole)
        elif os.path.isdir(whole):
            roots.append(whole)
    return [r for r in roots if os.path.isdir(r)], files


def list_workspace(spark: SparkSession, workspace: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(abs_path, path, source, hash, mtime, size, text) of every Markdown file, each once, in order of path.

    The digest is over bytes; the text is decoded as UTF-8 with U+FFFD for what isn't, all line ends as \\n.
    """
    workspace = os.path.abspath(workspace)
    roots, files = _places(workspace, extra)
    if not roots and not files:
        return spark.createDataFrame([], "abs_path string, path string, source string, hash string, mtime double, size long, text string")
    rows = None
    for group, deep in ((roots, True), (files, False)):
        if group:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", "*.md").load([f"file://{p}" for p in group])
            rows = found if rows is None else rows.unionByName(found)
    rows = rows.withColumn("abs_path", _local(F.col("path"))).dropDuplicates(["abs_path"]).filter(~F.contains(F.col("abs_path"), F.lit(f"/{OWN_FOLDER}/")))
    path, mtime = scalar.relative_key(F.col("abs_path"), workspace), F.unix_micros("modificationTime") / 1e6
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    return rows.select("abs_path", path.alias("path"), scalar.source_label(path).alias("source"), F.sha2("content", 256).alias("hash"), mtime.alias("mtime"), F.col("length").alias("size"), text.alias("text")).orderBy("path")


def file_entry(path: str) -> dict:
    """Digest, change time and size of one local file."""
    import hashlib

    with open(path, "rb") as f:
        content = f.read()
    stat = os.stat(path)
    return {"hash": hashlib.sha256(content).hexdigest(), "mtime": stat.st_mtime, "size": stat.st_size}


def append_note(path: str, text: str) -> None:
    """Adds a paragraph: a blank line goes before it unless the file is empty or ends with one, a line end after it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    before = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = f.read()
    with open(path, "a", encoding="utf-8") as f:
        f.write(("" if not before or before.endswith("\n\n") else "\n\n") + text + "\n")


def session_notes(turns: DataFrame) -> DataFrame:
    """(session_id, text) from (session_id, date, turn, role, text): what users said under a header; sessions without it are left out."""
    said = turns.filter("role = 'user'").groupBy("session_id", "date").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("said"))
    body = F.array_join(F.transform("said", lambda t: F.coalesce(t["text"], F.lit(""))), "\n\n")
    return said.select("session_id", F.concat(F.lit("# Session: "), F.col("session_id"), F.lit("\nDate: "), F.col("date"), F.lit("\n\n"), body).alias("text"))


def read_questions(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """A JSON array of question records; with `wanted` (question_id), those alone."""
    rows = spark.read.json(path, multiLine=True)
    return rows if wanted is None else rows.join(wanted.select("question_id"), "question_id", "left_semi")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, part) of a split file with the lists dev and held_out."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("dev").alias("question_id"), F.lit("dev").alias("part")).union(raw.select(F.explode("held_out"), F.lit("held_out")))


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def is_watched(path: str) -> bool:
    """Whether a change of this file matters: Markdown, and not the engine's own."""
    return path.endswith(".md") and OWN_FOLDER not in re.split(r"[\\/]", path)
