"""The folder that all executors share, and when a table last changed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir.

    A temporary folder of this machine serves only where the session names none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="notegrove-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and change times of a table's files, whatever file system it lies on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        one = found.next()
        out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(out))
