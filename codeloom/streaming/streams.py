"""Streams of files and events. The engine is a batch engine; these are extensions with the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import rules
from codeloom.sources.files import named


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come: path, filename, language, code."""
    found = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").schema("value string").load(folder)
    return named(found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code")))


def stream_issues(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the rule issues of streamed files that are not Python to a Parquet folder, what there is now."""
    found = rules.issue_rows(rules.with_rules(files.where("language <> 'python'")), "style_issues", "path")
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, value of tumbling windows; works on a stream (with its watermark) and on a table."""
    # watermarks need a time with a zone; the session's is taken, and taken off again
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end, n: events of a user less than gap apart."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
