"""Structured Streaming: a watched folder that is indexed as files come, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the files that come into a folder: id, file_path, file_type, file_hash, content."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return rows.select(F.substring(F.sha2("path", 256), 1, 32).alias("id"), F.col("path").alias("file_path"), files.file_type(F.col("path")).alias("file_type"), F.sha2("content", 256).alias("file_hash"), "content")


def index_stream(stream: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `index` on each micro-batch; a batch may come again after a failure, so index must replace by id (store.upsert does)."""
    writer = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by type and time window, late ones up to `late` counted; the same on a stream and on a table."""
    t = F.col("ts").cast("timestamp")
    w = F.window("t", width, slide) if slide else F.window("t", width)
    return events.withColumn("t", t).withWatermark("t", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events with gaps under `gap`."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).groupBy(F.session_window("t", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, with state kept for `late` only."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark(["event_id"]).drop("t")
