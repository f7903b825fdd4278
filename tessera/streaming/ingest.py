"""Ingest as a stream: files as they arrive, sessions as they close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELTA = "session_id string, note_path string, ts long, seq long, event_type string, user_event string, inserted long, deleted long"


def watched(spark: SparkSession, path: str, on_change: Callable[[list[str], int], None], checkpoint: str, glob: str | None = None, seconds: int | None = None) -> StreamingQuery:
    """Call on_change(paths, batch) with the files that are new below path: every so many seconds, or once for all that wait.

    What was seen is kept in checkpoint, so a restart doesn't repeat it.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path")

    def batch(rows: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in rows.distinct().collect())
        if paths:
            on_change(paths, number)

    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def deltas(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Writing deltas from JSON lines as they arrive; a line that can't be read is left out."""
    reader = spark.readStream.schema(DELTA + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.json(path).where("_corrupt_record is null and session_id is not null and ts is not null")
    return rows.drop("_corrupt_record").withColumn("at", F.timestamp_millis("ts"))


def without_repeats(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of a stream, each key once; state is dropped after `late`."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def sessions(rows: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a note that end after a gap; a start that comes late widens its session while it is within the watermark."""
    window = F.session_window("at", gap)
    grouped = rows.withWatermark("at", late).groupBy(window.alias("w"), "session_id")
    return grouped.agg(F.min("note_path").alias("note_path"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("events"), F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted")).drop("w")


def rates(rows: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window of time and kind."""
    return rows.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def seconds_of(interval: str) -> int:
    """Seconds of '15m', '1h', '2d', 'hourly', 'daily' or 'weekly'."""
    named = {"hourly": 3600, "daily": 86_400, "weekly": 604_800}
    if interval in named:
        return named[interval]
    number, unit = interval[:-1], interval[-1:]
    if not number.isdigit() or unit not in "smhd" or not unit:
        raise ValueError(f"no interval: {interval!r}")
    return int(number) * dict(zip("smhd", (1, 60, 3600, 86_400), strict=True))[unit]
