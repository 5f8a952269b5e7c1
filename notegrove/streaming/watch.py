"""Streams of file changes: a workspace that indexes itself, and the debouncing of change events."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegrove.sources.files import OWN_FOLDER
from notegrove.sources.shared import shared_path

log = logging.getLogger("notegrove")
FILE_EVENTS = "path string, ts timestamp"


def file_stream(spark: SparkSession, workspace: str) -> DataFrame:
    """(path, ts) of Markdown files as they appear below memory/, which is made if it isn't there."""
    root = os.path.join(workspace, "memory")
    os.makedirs(root, exist_ok=True)
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"file://{root}")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts")).filter(~F.contains("path", F.lit(f"/{OWN_FOLDER}/")))


def watch_workspace(spark: SparkSession, workspace: str, sync: Callable[[], object], debounce_ms: int = 1500, once: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Calls sync for every batch of changes; what it raises is logged and the watch goes on.

    The stream only says when to look: edits in place and deletions leave no new file, and sync compares the whole
    listing with what is stored. checkpoint: a folder in which the stream keeps what it has seen over restarts; a fresh one
    in the shared folder if None. Batches come `debounce_ms` apart, so changes in between are one.
    """

    def batch(rows: DataFrame, _: int) -> None:
        try:
            if not rows.isEmpty():
                sync()
        except Exception:
            log.exception("a change could not be indexed")

    writer = file_stream(spark, workspace).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or shared_path(spark, "watch"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(debounce_ms, 1)} milliseconds")).start()


def debounce(events: DataFrame, gap_ms: int = 1500, late: str = "1 minute") -> DataFrame:
    """(path, first_ts, last_ts, changes): events of a path less than gap_ms apart are one change.

    Works on streams, where a change is given once `late` has passed after it, and on tables alike.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("path", F.session_window("ts", f"{gap_ms} milliseconds")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("changes")).drop("session_window")
