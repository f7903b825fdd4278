"""Writing sessions from a stream of deltas, and questions about them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import Text


def sessions(deltas: DataFrame) -> DataFrame:
    """One row a session: first and last time, and counts; what arrives late only widens it."""
    change = F.col("event_type") == "change"
    return deltas.groupBy("session_id").agg(
        F.min("note_path").alias("note_path"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.count_if(change).alias("doc_change_count"), F.count_if(~change).alias("selection_change_count"),
        F.count_if(F.col("inserted") > 0).alias("insert_count"), F.count_if(F.col("deleted") > 0).alias("delete_count"),
        F.sum("inserted").alias("total_inserted_chars"), F.sum("deleted").alias("total_deleted_chars"),
        F.count_if(F.col("user_event") == "undo").alias("undo_count"), F.count_if(F.col("user_event") == "input.paste").alias("paste_count"),
    )


def merged_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of two batches as one: earliest start, latest end, sums."""
    both = old.unionByName(new)
    sums = [c for c in old.columns if c.endswith(("_count", "_chars"))]
    return both.groupBy("session_id").agg(F.min("note_path").alias("note_path"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *[F.sum(c).alias(c) for c in sums])


def rewrite_ratio() -> Column:
    inserted = F.coalesce(F.col("total_inserted_chars"), F.lit(0))
    return F.round(F.when(inserted > 0, F.coalesce(F.col("total_deleted_chars"), F.lit(0)) / inserted).otherwise(0.0), 3)


def writing_arc(sessions: DataFrame, note_path: str, limit: int = 20) -> DataFrame:
    """Sessions of a note, latest first."""
    rows = sessions.where(F.col("note_path") == note_path)
    return rows.withColumns({"duration_ms": F.col("ended_at") - F.col("started_at"), "rewrite_ratio": rewrite_ratio()}).orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)


def session_detail(deltas: DataFrame, session_id: str, n: int = 10) -> DataFrame:
    """(part, position, ...): the first n deltas, the last n in order of time, and all reversals of a session."""
    rows = deltas.where(F.col("session_id") == session_id)
    up = Window.orderBy(F.asc_nulls_first("ts"), "seq")
    down = Window.orderBy(F.desc_nulls_last("ts"), F.desc("seq"))
    kept = ["ts", "seq", "event_type", "user_event", "inserted", "deleted"]
    first = rows.withColumn("position", F.row_number().over(up)).where(F.col("position") <= n).select(F.lit("first").alias("part"), "position", *kept)
    last = rows.withColumn("_d", F.row_number().over(down)).where(F.col("_d") <= n).withColumn("position", F.row_number().over(up)).select(F.lit("last").alias("part"), "position", *kept)
    back = rows.where(F.col("user_event").isin("undo", "input.paste")).withColumn("position", F.row_number().over(up)).select(F.lit("reversal").alias("part"), "position", *kept)
    return first.unionByName(last).unionByName(back)


def day_ms(day: str, end: bool = False) -> int | None:
    """Milliseconds at the beginning of a day in UTC, or of the day after; None for what is no day."""
    try:
        at = date.fromisoformat(day)
    except (ValueError, TypeError):
        return None
    return ((at - date(1970, 1, 1)).days + int(end)) * 86_400_000


def _bounded(sessions: DataFrame, since: Text, until: Text, note_path: str | None) -> DataFrame:
    if since and day_ms(since) is not None:
        sessions = sessions.where(F.col("started_at") >= day_ms(since))
    if until and day_ms(until, True) is not None:
        sessions = sessions.where(F.col("started_at") < day_ms(until, True))
    return sessions.where(F.col("note_path") == note_path) if note_path else sessions


def writing_stats(sessions: DataFrame, since: Text = None, until: Text = None, note_path: Text = None) -> DataFrame:
    rows = _bounded(sessions, since, until, note_path)
    sums = ["doc_change_count", "selection_change_count", "insert_count", "delete_count", "total_inserted_chars", "total_deleted_chars", "undo_count", "paste_count"]
    out = rows.agg(F.count("*").alias("session_count"), F.countDistinct("note_path").alias("notes_touched"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.min("started_at").alias("earliest_start"), F.max(F.coalesce("ended_at", "started_at")).alias("latest_end"))
    return out.withColumn("rewrite_ratio", rewrite_ratio())


def top_notes(sessions: DataFrame, since: Text = None, until: Text = None, note_path: Text = None, n: int = 10) -> DataFrame:
    rows = _bounded(sessions, since, until, note_path).groupBy("note_path").agg(F.count("*").alias("session_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("doc_change_count", "total_inserted_chars", "total_deleted_chars")])
    return rows.orderBy(F.desc("doc_change_count"), F.desc("session_count"), "note_path").limit(n)
