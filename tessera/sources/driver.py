"""Domain tables as projections of the driver's tables; every one has the same rows as the SQL of its name in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        F.lit("emails").alias("source_table"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"),
        F.lower(F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".example"))).alias("sender_address"), F.col("c_name").alias("sender_name"),
        F.when(F.col("o_orderstatus") == "O", "outbound").when(F.col("o_orderstatus") == "F", "inbound").otherwise("self").alias("direction"),
        F.date_format("o_orderdate", _ISO).alias("date_sent"), F.col("o_orderpriority").startswith("5").cast("int").alias("is_bulk"),
        F.col("o_custkey").cast("string").alias("thread_id"), F.lit(None).cast("string").alias("kind"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "o_orderkey").alias("body_text"),
    )


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.lit("chat_messages").alias("source_table"), F.col("event_id").alias("id"), kind.alias("subject"),
        F.concat(F.lit("user"), "user_id").alias("sender_address"), F.concat(F.lit("User "), "user_id").alias("sender_name"),
        F.when(kind == "purchase", "outbound").when(kind == "error", "self").otherwise("inbound").alias("direction"),
        F.date_format("ts", _ISO).alias("date_sent"), (kind == "view").cast("int").alias("is_bulk"),
        F.lit(None).cast("string").alias("thread_id"), F.lit(None).cast("string").alias("kind"), F.col("props").alias("body_text"),
    )


def conversations_messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.col("role")
    return table(spark, d, "conversations").select(
        F.lit("conversations_messages").alias("source_table"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(None).cast("string").alias("subject"),
        role.alias("sender_address"), role.alias("sender_name"),
        F.when(role == "user", "outbound").when(role == "assistant", "inbound").otherwise("self").alias("direction"),
        F.concat(F.date_add(F.lit("2015-01-01").cast("date"), ((F.col("conv_id") * 7) % 3650).cast("int")).cast("string"), F.lit("T00:00:00")).alias("date_sent"),
        F.lit(0).alias("is_bulk"), F.lit(None).cast("string").alias("thread_id"),
        F.when(role.isin("user", "assistant"), "message").otherwise("meta").alias("kind"), F.col("text").alias("body_text"),
    )


def comm(spark: SparkSession, d: str) -> DataFrame:
    return emails(spark, d).unionByName(chat_messages(spark, d)).unionByName(conversations_messages(spark, d))


def recipients(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, id, address): suppliers of an order's lines; for an outbound chat message, the next user."""
    line, s, e = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "events")
    mail = line.join(s, line.l_suppkey == s.s_suppkey).select(F.lit("emails").alias("source_table"), F.col("l_orderkey").alias("id"), F.col("s_name").alias("address")).distinct()
    chat = e.where("event_type = 'purchase'").select(F.lit("chat_messages").alias("source_table"), F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id") + 1).alias("address"))
    return mail.unionByName(chat)


def threads(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, id, thread): the inThread statements."""
    mail = table(spark, d, "orders").select(F.lit("emails").alias("source_table"), F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("thread"))
    chat = table(spark, d, "events").select(F.lit("chat_messages").alias("source_table"), F.col("event_id").alias("id"), F.concat(F.lit("day"), F.date_format("ts", "yyyy-MM-dd")).alias("thread"))
    return mail.unionByName(chat)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of the corpus, with a date made from their ids."""
    day = F.date_add(F.lit("2015-01-01").cast("date"), ((F.col("doc_id") * 7) % 3650).cast("int")).cast("string")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("source_table"), F.col("doc_id").alias("source_id"), F.col("lang").alias("title"), F.col("text").alias("content"),
        day.alias("date_sent"), F.col("source").alias("source_kind"), (F.col("doc_id") % 10 == 0).cast("int").alias("is_bulk"),
        F.when(F.col("doc_id") % 7 == 0, "meta").otherwise("message").alias("kind"), F.col("n_chars"),
    )


def engagements(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, engaged_at): each event is an engagement with the chunk of its number, modulo the user count of a thousand."""
    return table(spark, d, "events").select((F.col("event_id") % 1000).alias("chunk_id"), F.date_format("ts", _ISO).alias("engaged_at"))


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """Events as writing deltas: a session is a user's day."""
    kind, n = F.col("event_type"), F.floor("value").cast("long")
    return table(spark, d, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.concat(F.lit("notes/"), F.col("user_id") % 40, F.lit(".md")).alias("note_path"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", "selection").otherwise("change").alias("event_type"),
        F.when(kind == "purchase", "undo").when(kind == "error", "input.paste").otherwise("input.type").alias("user_event"),
        F.when(kind.isin("view", "error"), n).otherwise(F.lit(0)).cast("long").alias("inserted"), F.when(kind.isin("click", "purchase"), n).otherwise(F.lit(0)).cast("long").alias("deleted"),
    )


def people(spark: SparkSession, d: str) -> DataFrame:
    """Identity emissions (id, full_name, email_domain, phone, discord_handle) of customers and suppliers; phones collide by design."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("n"), "c_nationkey", F.lit(".example")).alias("email_domain"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("(555) 010-"), F.lpad((F.col("c_custkey") % 500).cast("string"), 4, "0"))).alias("phone"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Handle"), F.col("c_custkey") % 350)).alias("discord_handle"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("full_name"), F.concat(F.lit("n"), "s_nationkey", F.lit(".example")).alias("email_domain"), F.concat(F.lit("555010"), F.lpad((F.col("s_suppkey") % 500).cast("string"), 4, "0")).alias("phone"), F.lit(None).cast("string").alias("discord_handle"))
    return c.unionByName(s)


def places(spark: SparkSession, d: str) -> DataFrame:
    """Points (id, name, lat, lon), many within a few hundred metres of each other."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("place "), k % 400).alias("name"), (F.lit(40.0) + (k % 97) * F.lit(0.00031)).alias("lat"), (F.lit(-75.0) + (k % 89) * F.lit(0.00037)).alias("lon"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as revisions of a path."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.lit("repo").alias("repo"), F.concat(F.lit("vault/"), "l_orderkey", F.lit(".md")).alias("file_path"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100).cast("long")).alias("commit_sha"),
        F.date_format("l_shipdate", _ISO).alias("captured_at"), F.when(flag == "A", "add").when(flag == "R", "delete").otherwise("modify").alias("change_type"),
        F.when(F.col("l_linestatus") == "O", "ai-coauthored").otherwise("owner-authored").alias("authorship"), F.floor(F.col("l_quantity") * 200).cast("long").alias("size_bytes"),
        F.when(F.col("l_tax") > 0.04, F.lit("summary")).alias("summary"),
    )


#: DuckDB views of the same rows, to be put before a query's SQL.
SQL = {
    "emails": "emails AS (SELECT 'emails' AS source_table, o_orderkey AS id, o_orderpriority AS subject, lower(c_name || '@' || c_mktsegment || '.example') AS sender_address, c_name AS sender_name, CASE o_orderstatus WHEN 'O' THEN 'outbound' WHEN 'F' THEN 'inbound' ELSE 'self' END AS direction, strftime(o_orderdate, '%xT%X') AS date_sent, CASE WHEN starts_with(o_orderpriority, '5') THEN 1 ELSE 0 END AS is_bulk, CAST(o_custkey AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS kind, o_orderpriority || ' ' || c_mktsegment || ' ' || o_orderkey AS body_text FROM orders JOIN customer ON o_custkey = c_custkey)",
    "chat": "chat_messages AS (SELECT 'chat_messages' AS source_table, event_id AS id, event_type AS subject, 'user' || user_id AS sender_address, 'User ' || user_id AS sender_name, CASE event_type WHEN 'purchase' THEN 'outbound' WHEN 'error' THEN 'self' ELSE 'inbound' END AS direction, strftime(ts, '%xT%X') AS date_sent, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_bulk, CAST(NULL AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS kind, props AS body_text FROM events)",
    "conv": "conversations_messages AS (SELECT 'conversations_messages' AS source_table, conv_id * 1000 + turn AS id, CAST(NULL AS VARCHAR) AS subject, role AS sender_address, role AS sender_name, CASE role WHEN 'user' THEN 'outbound' WHEN 'assistant' THEN 'inbound' ELSE 'self' END AS direction, strftime(DATE '2015-01-01' + CAST((conv_id * 7) % 3650 AS INTEGER), '%Y-%m-%d') || 'T00:00:00' AS date_sent, 0 AS is_bulk, CAST(NULL AS VARCHAR) AS thread_id, CASE WHEN role IN ('user', 'assistant') THEN 'message' ELSE 'meta' END AS kind, text AS body_text FROM conversations)",
    "comm": "comm AS (SELECT * FROM emails UNION ALL SELECT * FROM chat_messages UNION ALL SELECT * FROM conversations_messages)",
    "recipients": "recipients AS (SELECT DISTINCT 'emails' AS source_table, l_orderkey AS id, s_name AS address FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 'chat_messages', event_id, 'user' || (user_id + 1) FROM events WHERE event_type = 'purchase')",
    "threads": "threads AS (SELECT 'emails' AS source_table, o_orderkey AS id, 'c' || o_custkey AS thread FROM orders UNION ALL SELECT 'chat_messages', event_id, 'day' || strftime(ts, '%Y-%m-%d') FROM events)",
    "chunks": "chunks AS (SELECT doc_id AS id, 'documents' AS source_table, doc_id AS source_id, lang AS title, text AS content, strftime(DATE '2015-01-01' + CAST((doc_id * 7) % 3650 AS INTEGER), '%Y-%m-%d') AS date_sent, source AS source_kind, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS is_bulk, CASE WHEN doc_id % 7 = 0 THEN 'meta' ELSE 'message' END AS kind, n_chars FROM documents)",
    "engagements": "engagements AS (SELECT event_id % 1000 AS chunk_id, strftime(ts, '%xT%X') AS engaged_at FROM events)",
    "deltas": "deltas AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, 'notes/' || (user_id % 40) || '.md' AS note_path, epoch_us(ts) // 1000 AS ts, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'selection' ELSE 'change' END AS event_type, CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'input.paste' ELSE 'input.type' END AS user_event, CASE WHEN event_type IN ('view', 'error') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS inserted, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS deleted FROM events)",
    "people": "people AS (SELECT c_custkey AS id, c_name AS full_name, 'n' || c_nationkey || '.example' AS email_domain, CASE WHEN c_custkey % 3 = 0 THEN '+1555010' || lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') END AS phone, CASE WHEN c_custkey % 7 = 0 THEN 'handle' || (c_custkey % 350) END AS discord_handle FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, 'n' || s_nationkey || '.example', '+1555010' || lpad(CAST(s_suppkey % 500 AS VARCHAR), 4, '0'), NULL FROM supplier)",
    "places": "places AS (SELECT c_custkey AS id, 'place ' || (c_custkey % 400) AS name, 40.0::DOUBLE + (c_custkey % 97) * 0.00031::DOUBLE AS lat, -75.0::DOUBLE + (c_custkey % 89) * 0.00037::DOUBLE AS lon FROM customer)",
    "revisions": "revisions AS (SELECT 'repo' AS repo, 'vault/' || l_orderkey || '.md' AS file_path, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice * 100) AS BIGINT) AS commit_sha, strftime(l_shipdate, '%xT%X') AS captured_at, CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'delete' ELSE 'modify' END AS change_type, CASE WHEN l_linestatus = 'O' THEN 'ai-coauthored' ELSE 'owner-authored' END AS authorship, CAST(floor(l_quantity * 200) AS BIGINT) AS size_bytes, CASE WHEN l_tax > 0.04 THEN 'summary' END AS summary FROM lineitem)",
}


def with_views(names: str, sql: str) -> str:
    """sql after the views that it needs."""
    order = list(SQL)
    wanted = set(names.split())
    if "comm" in wanted:
        wanted |= {"emails", "chat", "conv"}
    views = ", ".join(SQL[n] for n in order if n in wanted)
    rest = sql.strip()
    return f"WITH {views}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {views} {rest}"
