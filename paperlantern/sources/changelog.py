"""The log of changes seen while nothing is listening.

A line is ``op:path``; a change that knows its time and number is written as
``op@micros#id:path``, so the log can be replayed in order whatever file a line is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.functions.paths import first_segment

_HEAD = r"^(create|update|delete)(?:@(-?[0-9]+)#(-?[0-9]+))?:"


def change_lines(changes: DataFrame) -> DataFrame:
    head = F.col("op")
    if "ts" in changes.columns and "event_id" in changes.columns:
        stamp = F.concat(F.lit("@"), F.unix_micros("ts").cast("string"), F.lit("#"), F.col("event_id").cast("string"))
        head = F.concat(head, F.coalesce(stamp, F.lit("")))
    return changes.select(F.concat_ws(":", head, "path").alias("value"))


def write_change_log(changes: DataFrame, path: str, checkpoint: str | None = None):
    """Append the changes as lines; a streaming input returns its running query."""
    lines = change_lines(changes)
    if changes.isStreaming:
        writer = lines.writeStream.format("text").option("path", path).outputMode("append")
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    lines.write.mode("append").text(path)
    return None


def parse_change_lines(lines: DataFrame, column: str = "value", ts: Column | None = None, event_id: Column | None = None) -> DataFrame:
    """Changes of the lines that are some; a path may contain more ``:``.

    ``ts`` and ``event_id`` stand in for lines that carry none of their own.
    """
    line = F.col(column)
    part = lambda n: F.nullif(F.regexp_extract(line, _HEAD, n), F.lit(""))
    path = F.regexp_replace(line, _HEAD, "")
    micros, number = part(2).cast("long"), part(3).cast("long")
    out = lines.select(
        first_segment(path).alias("index_id"), path.alias("path"), part(1).alias("op"),
        F.coalesce(F.timestamp_micros(micros), F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"),
        F.coalesce(number, F.lit(None).cast("long") if event_id is None else event_id).alias("event_id"),
    )
    return out.where(F.col("op").isNotNull() & (F.col("path") != ""))


def read_change_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The log as changes: ``index_id, path, op, ts, event_id``, as table or stream.

    A line without a stamp has the time of its file; in a table also its place
    there, in a stream the number 0.
    """
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("text").schema("value string").load(path)
    raw = raw.select("value", F.col("_metadata.file_modification_time").alias("at"))
    place = F.lit(0).cast("long") if streaming else F.monotonically_increasing_id()
    return parse_change_lines(raw.withColumn("place", place), "value", F.col("at"), F.col("place"))
