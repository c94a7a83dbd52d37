"""Versioned trees as streams: new sessions as they are published, checked against the session before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabox.sources.archive import register


def session_stream(spark: SparkSession, path: str, view: str = "sessions") -> DataFrame:
    """Rows of sessions (or nodes) published since the last batch. A torn tail is not read until its trailer is whole."""
    register(spark)
    return spark.readStream.format("archive").option("view", view).load(path)


def changes_by_window(sessions: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Record counts by archive and window of commit time, with late sessions let in for `late`."""
    timed = sessions.select("path", "session_seq", F.timestamp_millis("ts_ms").alias("ts"), "change_count").withWatermark("ts", late)
    return timed.groupBy("path", F.window("ts", width)).agg(F.sum("change_count").alias("changes"))
