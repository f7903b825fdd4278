"""Sources by name: what is read, by which parser."""

from __future__ import annotations

import importlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.merge import first_wins
from tessera.sources import parsers as p
from tessera.sources.records import Parser, read_files, read_split


@dataclass(frozen=True)
class Source:
    """glob: files below the path that belong to it. separator: what stands before each part of a file that may be cut there."""

    parser: Parser
    emits: tuple[str, ...]
    glob: str | None = None
    separator: str | None = None


_MD = "*.md"
SOURCES: dict[str, Source] = {
    "amazon": Source(p.amazon, ("Product", "OrderAction", "Review", "WatchAction")),
    "apple_dbs": Source(p.database, ("BrowseAction", "Message", "Action", "DigitalDocument")),
    "apple_health": Source(p.apple_health, ("Observation", "ExerciseAction", "MedicalRecord", "GeoShape")),
    "apple_health_backup": Source(p.database, ("Observation", "ExerciseAction")),
    "apple_notes_full": Source(p.database, ("DigitalDocument",)),
    "articles": Source(p.markdown, ("Article",), _MD),
    "assistant_chat": Source(p.assistant_export, ("Conversation",), "*.json"),
    "browser_bookmarks": Source(p.bookmarks, ("BookmarkAction",)),
    "calendar": Source(p.ical, ("Event",), "*.ics"),
    "chat_logs": Source(p.chat_log, ("Message",)),
    "chrome_history": Source(p.chrome_history, ("BrowseAction",), "*.json"),
    "clippings": Source(p.markdown, ("Quotation",), _MD),
    "coding_sessions": Source(p.session_jsonl, ("Conversation",), "*.jsonl"),
    "consumed_media": Source(p.markdown, ("Movie", "Book", "WebSite", "TVSeries", "VideoGame", "PodcastSeries"), _MD),
    "discord": Source(p.discord, ("Message",)),
    "discord_dce": Source(p.discord, ("Message",), "*.json"),
    "facebook_connections": Source(p.facebook, ("BefriendAction",), "*.html"),
    "facebook_unified": Source(p.facebook, ("Comment", "Event", "JoinAction", "LikeAction", "Message", "SocialMediaPosting")),
    "file_revisions": Source(p.git_log, ("FileRevision",)),
    "goodreads": Source(p.goodreads, ("Book",), "*.csv"),
    "google_activity": Source(p.activity_html, ("SearchAction", "WatchAction", "Action")),
    "google_contacts": Source(p.vcard, ("Person",)),
    "google_drive": Source(p.document, ("DigitalDocument",)),
    "google_fit": Source(p.google_fit, ("Observation", "ExerciseAction"), "*.json"),
    "google_search": Source(p.activity_html, ("SearchAction",), "*.html"),
    "google_timeline": Source(p.timeline, ("TravelAction", "Place", "GeoShape"), "*.json"),
    "google_voice": Source(p.message_html, ("Message",), "*.html"),
    "imessage": Source(p.message_html, ("Message",), "*.html"),
    "mbox": Source(p.mbox, ("EmailMessage",), "*.mbox", "\nFrom "),
    "msn_plus": Source(p.chat_log, ("Message",)),
    "onedrive": Source(p.document, ("DigitalDocument",)),
    "phone_calls_xml": Source(p.sms_xml, ("Action",), "*.xml"),
    "phone_photos": Source(p.photo, ("Photograph",)),
    "phone_sms": Source(p.database, ("Message",)),
    "raindrop": Source(p.bookmarks, ("BookmarkAction",)),
    "readaction": Source(p.markdown, ("ReadAction",), _MD),
    "session_buddy": Source(p.session_buddy, ("BrowserSession", "SessionTab"), "*.json"),
    "sms_xml": Source(p.sms_xml, ("Message",), "*.xml"),
    "spotify": Source(p.spotify, ("ListenAction",)),
    "staged_md": Source(p.markdown, ("CreativeWork", "Article", "DigitalDocument"), _MD),
    "strong": Source(p.database, ("ExerciseAction",)),
    "vault_entities": Source(p.markdown, ("Person", "Organization", "Place"), _MD),
    "vault_tasks_plans": Source(p.markdown, ("VaultTask", "VaultPlan"), _MD),
    "writing_deltas": Source(p.writing_deltas, ("WritingDelta",), "*.ndjson"),
    "youtube_activity": Source(p.activity_html, ("WatchAction", "SearchAction"), "*.html"),
    "youtube_subscriptions": Source(p.youtube_subscriptions, ("FollowAction",), "*.csv"),
}


def read(spark: SparkSession, source: str, path: str, after: int = 0) -> DataFrame:
    """All records of a source below path; after: bytes of a growing file that were read before, for sources with a separator."""
    s = SOURCES[source]
    return read_split(spark, path, s.parser, s.separator, s.glob, after) if s.separator else read_files(spark, path, s.parser, s.glob)


def ingest(spark: SparkSession, source: str, path: str, stored: DataFrame | None = None, after: int = 0) -> DataFrame:
    """Records that aren't stored yet, each once by (source_path, raw_hash); errors aside."""
    keys = ["source_path", "raw_hash"]
    rows = first_wins(read(spark, source, path, after).where("schema_type <> 'Error'"), keys, [F.asc("entry"), F.asc("position")])
    return rows if stored is None else rows.join(stored.select(*keys), keys, "left_anti")


def errors(records: DataFrame) -> DataFrame:
    """(source_path, entry, what) of what couldn't be read."""
    return records.where("schema_type = 'Error'").select("source_path", "entry", F.col("body_text").alias("what"))


def unclaimed(records: DataFrame, source: str) -> DataFrame:
    """(schema_type, n) that a source yielded and doesn't claim to."""
    return records.where(~F.col("schema_type").isin("Error", *SOURCES[source].emits)).groupBy("schema_type").agg(F.count("*").alias("n"))


def manifest() -> list[dict]:
    """What each source is, as plain values: name, what it emits, which files it reads and whether they are cut."""
    return [{"name": name, "emits": list(s.emits), "glob": s.glob, "splittable": s.separator is not None} for name, s in sorted(SOURCES.items())]


def discovered(modules: list[str]) -> dict[str, Source]:
    """SOURCES and those that the named modules bring as their own SOURCES; a name that is taken, and a source that isn't valid, are errors."""
    found = dict(SOURCES)
    for m in modules:
        more = importlib.import_module(m).SOURCES
        if taken := sorted(found.keys() & more.keys()):
            raise ValueError(f"{m} names sources that exist: {', '.join(taken)}")
        found |= more
    if bad := invalid(found):
        raise ValueError(f"not valid: {', '.join(bad)}")
    return found


def invalid(sources: dict[str, Source]) -> list[str]:
    """Names whose entry lacks a parser or what it emits."""
    return [name for name, s in sources.items() if not callable(s.parser) or not s.emits or not name.isidentifier()]
