"""The tables that records are kept in."""

from __future__ import annotations

from tessera.schema.specs import Field, Table


def _action(name: str, schema_type: str, date: str, more: str = "", sender: bool = False, embeddable: bool = False, communication: bool = False, outbound: bool = False, bulk: int = 0) -> Table:
    """The shape that most records share: who, when, what text, from which file. more: further columns, 'name:kind' or name."""
    extra = tuple(Field(*x.split(":")) for x in more.split())
    who = (Field("sender_address"), Field("sender_name")) if sender else ()
    fields = (
        Field("id", "long", False), Field("schema_type", default=schema_type), Field("subject"), *who, *extra, Field("direction", default="outbound" if outbound else "unknown"), Field(date),
        Field("body_text"), Field("body_text_source"), Field("body_text_hash"), Field("is_bulk", "long", default=bulk), Field("bulk_signal"), Field("raw_hash", nullable=False), Field("source_file_id", "long", False, references="source_files"), Field("created_at"),
    )
    return Table(name, schema_type, fields, ("source_file_id", "raw_hash"), date, embeddable=embeddable, communication=communication)


def _entity(name: str, schema_type: str, key: str, more: str = "") -> Table:
    return Table(name, schema_type, (Field("id", "long", False), Field("schema_type", default=schema_type), Field(key, nullable=False), *(Field(*x.split(":")) for x in more.split()), Field("created_at")), (key,), entity=True)


_MAIL = "rfc822_message_id gmail_thread_id gmail_labels:strings sender_domain date_received is_multipart:long has_attachments:long attachment_count:long source_byte_offset:long source_byte_length:long"
_TABLES = [
    _action("emails", "EmailMessage", "date_sent", _MAIL, True, True, True),
    _action("chat_messages", "Message", "date_sent", "message_key sender_domain date_received has_attachments:long attachment_count:long", True, True, True),
    _action("conversations_messages", "Conversation", "date_sent", "conversation_key sender_domain kind role parent_uuid tool_name model", True, True, True),
    _action("observations", "Observation", "date_observed", "date_end observation_key", bulk=1),
    _action("exercise_actions", "ExerciseAction", "date_performed", "date_end"),
    _action("search_actions", "SearchAction", "date_performed", "web_page_id:long"),
    _action("listen_actions", "ListenAction", "date_listened"),
    _action("watch_actions", "WatchAction", "date_watched", "web_page_id:long"),
    _action("actions", "Action", "date_performed"),
    _action("events", "Event", "date_occurred", embeddable=True),
    _action("products", "Product", "date_recorded"),
    _action("order_actions", "OrderAction", "date_ordered"),
    _action("like_actions", "LikeAction", "date_liked"),
    _action("follow_actions", "FollowAction", "date_followed", "web_page_id:long"),
    _action("persons", "Person", "date_recorded"),
    _action("places", "Place", "date_recorded"),
    _action("things", "Thing", "date_recorded"),
    _action("social_postings", "SocialMediaPosting", "date_posted", embeddable=True, outbound=True),
    _action("comments", "Comment", "date_posted", embeddable=True, outbound=True),
    _action("travel_actions", "TravelAction", "date_traveled"),
    _action("geo_shapes", "GeoShape", "date_recorded"),
    _action("medical_records", "MedicalRecord", "date_recorded"),
    _action("reviews", "Review", "date_reviewed", embeddable=True),
    _action("books_legacy", "BookLegacy", "date_recorded"),
    _action("invite_actions", "InviteAction", "date_invited"),
    _action("join_actions", "JoinAction", "date_joined"),
    _action("creative_works", "CreativeWork", "date_created", embeddable=True),
    _action("digital_documents", "DigitalDocument", "date_created", embeddable=True),
    _action("browse_actions", "BrowseAction", "visit_time", "web_page_id:long"),
    _action("read_actions", "ReadAction", "date_read", "web_page_id:long"),
    _action("documents", "DigitalDocument", "mtime", "file_path bucket ctime", embeddable=True),
    _action("articles", "Article", "mtime", "file_path url author", embeddable=True),
    _action("clippings", "Quotation", "mtime", "file_path url", embeddable=True),
    _action("photographs", "Photograph", "captured_at", "file_path lat:double lon:double camera"),
    Table("bookmarks", "BookmarkAction", (Field("id", "long", False), Field("web_page_id", "long", False, references="web_pages"), Field("instrument", nullable=False), Field("first_seen_in_instrument"), Field("last_seen_in_instrument"), Field("appearance_count", "long", default=1), Field("tags", "strings"), Field("folder")), ("web_page_id", "instrument"), "first_seen_in_instrument", embeddable=True),
    Table("file_revisions", "FileRevision", (Field("id", "long", False), Field("repo", nullable=False), Field("commit_sha", nullable=False), Field("file_path", nullable=False), Field("captured_at"), Field("change_type"), Field("authorship"), Field("summary"), Field("size_bytes", "long"), Field("old_path")), ("repo", "commit_sha", "file_path"), "captured_at"),
    Table("dissolutions", "DissolutionEvent", (Field("id", "long", False), Field("plan_pk", "long"), Field("migration_id"), Field("file_path"), Field("commit_sha"), Field("reason", nullable=False), Field("target_tables", "strings"), Field("dissolved_at")), ("plan_pk", "migration_id"), "dissolved_at"),
    Table("materialization_events", "MaterializationEvent", (Field("id", "long", False), Field("run_id"), Field("file_path"), Field("rows", "long"), Field("materialized_at")), (), "materialized_at"),
    _entity("web_pages", "WebPage", "normalized_url", "url title excerpt cover domain first_seen last_seen"),
    *[_entity(n, t, "name", "url image keywords:strings") for n, t in (("books", "Book"), ("games", "VideoGame"), ("movies", "Movie"), ("tv_series", "TVSeries"), ("podcasts", "PodcastSeries"), ("youtube_channels", "WebSite"), ("twitch_channels", "WebSite"), ("tasks", "VaultTask"), ("plans", "VaultPlan"))],
    _entity("browser_sessions", "BrowserSession", "source_id", "timestamp:long kind"),
    Table("session_tabs", "SessionTab", (Field("id", "long", False), Field("session_id", "long", False, references="browser_sessions"), Field("url"), Field("title"), Field("active", "boolean", default=False), Field("created_at")), (), "created_at"),
    _entity("sessions", "Session", "session_key", "started_at ended_at"),
    _action("session_events", "SessionEvent", "ts", "session_id:long kind"),
    Table("chunks", "Chunk", (Field("id", "long", False), Field("source_table", nullable=False), Field("source_id", "long", False), Field("chunk_index", "long", False), Field("schema_type"), Field("title"), Field("content"), Field("content_hash"), Field("metadata", "map")), ("source_table", "source_id", "chunk_index")),
    Table("doc_vectors", "Vector", (Field("id", "long", False, references="chunks"), Field("embedding", "floats", False)), ("id",)),
    Table("nodes", "Node", (Field("id", "long", False), Field("kind", nullable=False), Field("label", nullable=False), Field("normalized_label", nullable=False), Field("source_table"), Field("source_id", "long")), ("kind", "normalized_label")),
    Table("triples", "Triple", (Field("id", "long", False), Field("subject_id", "long", False, references="nodes"), Field("predicate", nullable=False), Field("object_id", "long", references="nodes"), Field("provenance"), Field("ref")), ("subject_id", "predicate", "object_id", "provenance", "ref")),
]
TABLES: dict[str, Table] = {t.name: t for t in _TABLES}


def by_schema_type(schema_type: str) -> list[Table]:
    """The tables that a type may be kept in."""
    return [t for t in _TABLES if t.schema_type == schema_type]


def communication() -> list[str]:
    """Tables of messages."""
    return list(filter(lambda name: TABLES[name].communication, TABLES))


def embeddable() -> list[str]:
    """Tables whose texts get vectors."""
    return list(filter(lambda name: TABLES[name].embeddable, TABLES))


def date_column(name: str, otherwise: str = "date_sent") -> str:
    """The column that dates a table's rows."""
    found = TABLES.get(name)
    return (found and found.date) or otherwise


def document() -> str:
    """The catalogue as Markdown."""
    heads = ["table", "type", "date", "key", "columns"]
    lines = ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    return "\n".join([*lines, *(f"| {t.name} | {t.schema_type} | {t.date or ''} | {', '.join(t.key)} | {', '.join(f.name for f in t.fields)} |" for t in _TABLES)]) + "\n"
