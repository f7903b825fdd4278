"""Queries over messages of all kinds.

Messages have (source_table, id, subject, sender_address, sender_name,
direction, date_sent, is_bulk, thread_id, kind, body_text); recipients
(source_table, id, address) and threads (source_table, id, thread) are the
sentTo and inThread statements about them. Ids are only unique within a
table, so everything joins on (source_table, id). Dates are ISO strings and
compare as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import Number, Text
from tessera.functions.values import in_range, json_map

KEY = ["source_table", "id"]


def get_message(comm: DataFrame, recipients: DataFrame, attachments: DataFrame | None, msg_id: int, table: Text = None) -> DataFrame:
    """The message of that id, with its recipients by label and attachments by id; of several tables' the first in order of email, chat, conversation."""
    found = comm.where(F.col("id") == msg_id)
    if table:
        found = found.where(F.col("source_table") == table)
    rank = F.when(F.col("source_table") == "emails", 0).when(F.col("source_table") == "chat_messages", 1).otherwise(2)
    found = found.orderBy(rank).limit(1)
    to = recipients.where(F.col("id") == msg_id).groupBy(KEY).agg(F.sort_array(F.collect_list("address")).alias("recipients"))
    out = found.join(to, KEY, "left").withColumn("recipients", F.coalesce("recipients", F.array().cast("array<string>")))
    if attachments is not None:
        files = attachments.where(F.col("message_id") == msg_id).groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "filename", "content_type", "size_bytes"))).alias("attachments"))
        out = out.join(files, "id", "left")
    return out


def get_thread(emails: DataFrame, thread_id: Text = None, msg_id: Number = None, max_messages: int = 50, preview: int = 300) -> DataFrame:
    """The emails of a thread, or of the thread of a message, by date."""
    if thread_id is None and msg_id is None:
        raise ValueError("provide thread_id or msg_id")
    if thread_id is not None:
        found = emails.where(F.col("thread_id") == thread_id)
    else:
        found = emails.join(emails.where((F.col("id") == msg_id) & (F.col("thread_id") != "")).select("thread_id").distinct(), "thread_id", "left_semi")
    rows = found.select(F.col("id").alias("msg_id"), "subject", "sender_address", "sender_name", "direction", "date_sent", "is_bulk", F.substring("body_text", 1, preview).alias("body_preview"))
    return rows.orderBy(F.asc_nulls_first("date_sent"), "msg_id").limit(max_messages)


def resolve_addresses(contacts: DataFrame, participant: str) -> DataFrame:
    """(address): lowercase addresses of the contacts whose name holds the text."""
    return contacts.where(F.lower("display_name").contains(participant.lower())).select(F.lower("address").alias("address")).distinct()


def get_conversation(chat: DataFrame, recipients: DataFrame, threads: DataFrame, participant: str, since: Text = None, until: Text = None, max_messages: int = 100, contacts: DataFrame | None = None, preview: int = 500) -> DataFrame:
    """Chat messages from a participant and, of the outbound ones, those to them or in a thread that they wrote in; newest first.

    The bounds compare with whole date strings, so a day as `until` ends at its midnight.
    """
    p = participant.lower()
    who = chat.where(F.lower("sender_name").contains(p) | F.lower("sender_address").contains(p)).select(F.lower("sender_address").alias("address")).distinct()
    if contacts is not None:
        who = who.union(resolve_addresses(contacts, participant)).distinct()
    kept = chat
    if since:
        kept = kept.where(F.col("date_sent") >= since)
    if until:
        kept = kept.where(F.col("date_sent") <= until)
    from_them = kept.join(who, F.lower("sender_address") == who.address, "left_semi").withColumn("direction", F.lit("inbound"))
    out = kept.where("direction = 'outbound'")
    to_them = out.join(recipients.join(who, F.lower(recipients.address) == who.address, "left_semi").select(KEY).distinct(), KEY, "left_semi")
    theirs = chat.join(who, F.lower("sender_address") == who.address, "left_semi").select(KEY).join(threads, KEY).select("thread").distinct()
    beside = out.join(threads.join(theirs, "thread", "left_semi").select(KEY).distinct(), KEY, "left_semi")
    rows = from_them.unionByName(to_them).unionByName(beside).select("source_table", F.col("id").alias("msg_id"), "direction", "sender_name", "sender_address", "date_sent", F.substring("body_text", 1, preview).alias("body_preview")).distinct()
    return rows.orderBy(F.desc_nulls_last("date_sent"), "source_table", "msg_id", "direction").limit(max_messages)


def stats_by_year(comm: DataFrame, since: Text = None, until: Text = None) -> DataFrame:
    return _bounded(comm, since, until).groupBy(F.substring("date_sent", 1, 4).alias("year")).agg(F.count("*").alias("messages"))


def stats_by_direction(comm: DataFrame, since: Text = None, until: Text = None) -> DataFrame:
    return _bounded(comm, since, until).groupBy("direction").agg(F.count("*").alias("n"))


def top_senders(comm: DataFrame, since: Text = None, until: Text = None, limit: int = 20) -> DataFrame:
    rows = _bounded(comm, since, until).where("is_bulk = 0").groupBy("sender_address").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "sender_address").limit(limit)


def _bounded(comm: DataFrame, since: Text, until: Text) -> DataFrame:
    return comm.where(in_range(F.col("date_sent"), since, until)) if since or until else comm


def find_messages_by_participant(comm: DataFrame, recipients: DataFrame, participant: str, role: str = "any", direction: Text = None, since: Text = None, until: Text = None, limit: int = 50, include_bulk: bool = False, contacts: DataFrame | None = None) -> DataFrame:
    """Messages with a participant as sender, recipient or either, newest first; matched_via lists how."""
    if role not in ("any", "sender", "recipient"):
        raise ValueError("role must be 'sender', 'recipient' or 'any'")
    p = participant.lower()
    known = resolve_addresses(contacts, participant) if contacts is not None else None
    kept = _bounded(comm, since, until)
    if direction:
        kept = kept.where(F.col("direction") == direction)
    if not include_bulk:
        kept = kept.where("is_bulk = 0")
    sender = F.lower("sender_address").contains(p) | F.lower(F.coalesce("sender_name", F.lit(""))).contains(p)
    to = recipients.where(F.lower("address").contains(p)).select(KEY)
    if known is not None:
        to = to.union(recipients.join(known, F.lower(recipients.address) == known.address, "left_semi").select(KEY))
        kept = kept.join(known.withColumn("_known", F.lit(True)), F.lower("sender_address") == known.address, "left").drop("address")
        sender = sender | F.coalesce("_known", F.lit(False))
    marked = kept.join(to.distinct().withColumn("_to", F.lit(True)), KEY, "left")
    via = F.concat_ws(",", F.when(F.coalesce("_to", F.lit(False)) & F.lit(role != "sender"), "recipient"), F.when(F.coalesce(sender, F.lit(False)) & F.lit(role != "recipient"), "sender"))
    rows = marked.withColumn("matched_via", via).where("matched_via <> ''")
    rows = rows.select("source_table", F.col("id").alias("msg_id"), F.substring("date_sent", 1, 10).alias("date"), "date_sent", "direction", F.coalesce(F.nullif("sender_name", F.lit("")), "sender_address").alias("sender"), "sender_address", "subject", "thread_id", "is_bulk", "matched_via")
    return rows.orderBy(F.desc_nulls_last("date_sent"), "source_table", "msg_id").limit(limit)


def find_threads_by_subject(emails: DataFrame, query: str, since: Text = None, until: Text = None, limit: int = 30) -> DataFrame:
    """Threads of which a subject, or the id, holds the text; latest first."""
    q = query.lower()
    rows = _bounded(emails, since, until).where(F.col("thread_id").isNotNull() & (F.lower(F.coalesce("subject", F.lit(""))).contains(q) | F.lower("thread_id").contains(q)))
    rolled = rows.groupBy("thread_id").agg(F.min("subject").alias("subject"), F.count("*").alias("message_count"), F.min("date_sent").alias("date_first"), F.max("date_sent").alias("date_last"))
    return rolled.orderBy(F.desc_nulls_last("date_last"), "thread_id").limit(limit)


def top_correspondents(comm: DataFrame, recipients: DataFrame, role: str = "sender", since: Text = None, until: Text = None, limit: int = 20, exclude_self: bool = True, exclude_bulk: bool = True) -> DataFrame:
    """Addresses by number of messages that they sent, got, or both."""
    kept = _bounded(comm, since, until)
    if exclude_bulk:
        kept = kept.where("is_bulk = 0")
    if exclude_self:
        kept = kept.where("direction <> 'self'")
    sent = kept.select(F.col("sender_address").alias("address"), F.col("sender_name").alias("name"))
    got = recipients.join(kept.select(KEY), KEY).select("address", F.lit(None).cast("string").alias("name"))
    legs = {"sender": [sent], "recipient": [got], "both": [sent, got]}
    if role not in legs:
        raise ValueError("role must be 'sender', 'recipient' or 'both'")
    rows = legs[role][0] if len(legs[role]) == 1 else sent.union(got)
    return rows.groupBy("address").agg(F.max("name").alias("name"), F.count("*").alias("message_count")).orderBy(F.desc("message_count"), F.asc_nulls_first("address")).limit(limit)


def list_sources(tables: dict[str, DataFrame], chunks: DataFrame, vectors: DataFrame, source_files: DataFrame) -> dict[str, DataFrame]:
    """Totals, sources by organisation and kind, and chunks with how many are embedded by table."""
    counts = None
    for name, t in sorted({**tables, "chunks": chunks, "vectors": vectors}.items()):
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    by_kind = source_files.groupBy("source_org", "source_kind").agg(F.count("*").alias("files"), F.sum("message_count").alias("messages")).orderBy(F.desc_nulls_last("messages"), "source_org", "source_kind")
    held = chunks.join(vectors.select(F.col("id")).distinct().withColumn("_v", F.lit(1)), "id", "left")
    by_table = held.groupBy("source_table").agg(F.count("*").alias("chunks"), F.count("_v").alias("embedded"))
    return {"totals": counts, "sources": by_kind, "chunks": by_table}


PARENT = ["source_table", "source_id", "subject", "sender_address", "sender_name", "date_sent", "direction", "thread_id", "is_bulk", "kind"]


def parents(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """(PARENT): one row for whatever a chunk can be cut from: messages of all tables, and documents(id, subject, bucket, mtime, ctime, created_at, is_bulk).

    A document has its bucket for a sender, and the first of its three dates.
    """
    null = F.lit(None).cast("string")
    docs = documents.select(F.lit("documents").alias("source_table"), F.col("id").alias("source_id"), "subject", null.alias("sender_address"), F.col("bucket").alias("sender_name"), F.coalesce("mtime", "ctime", "created_at").alias("date_sent"), null.alias("direction"), null.alias("thread_id"), "is_bulk", null.alias("kind"))
    return messages.withColumnRenamed("id", "source_id").select(*PARENT).unionByName(docs)


def get_chunk(chunks: DataFrame, parents: DataFrame, chunk_id: int) -> DataFrame:
    """The chunk of that id with its parent's fields and its metadata (JSON) as a map; no row if there is none."""
    mine = chunks.where(F.col("id") == chunk_id)
    meta = json_map(F.col("metadata")) if "metadata" in chunks.columns else F.lit(None).cast("map<string,string>")
    rows = mine.withColumn("metadata", meta).join(parents.drop("title"), ["source_table", "source_id"], "left")
    return rows.select("id", "source_table", "source_id", "content", "subject", "sender_address", "date_sent", "direction", "metadata")


def server_info(tables: dict[str, DataFrame], chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts: messages of all tables, chunks, vectors."""
    typed = None
    for t in tables.values():
        one = t.agg(F.count("*").alias("n"))
        typed = one if typed is None else typed.union(one)
    return typed.agg(F.sum("n").alias("messages")).crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(vectors.agg(F.count("*").alias("vectors")))
