"""Search, message and writing queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import comm, coverage, embed, scoring, search, writing
from tessera.sources import driver as d
from tessera.sources.driver import with_views

POLICY = scoring.Policy(by_source_kind={"src1": "fast", "src2": "warm", "src3": "evergreen"})
AS_OF = "2025-01-01 00:00:00"

_TOK = r"list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_STAT = f"tok AS (SELECT id, date_sent, {_TOK} AS t FROM chunks), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok WHERE len(t) > 0)"


def _bm25_sql(words: list[str], op: str, k: int, extra: str = "") -> str:
    n = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in words]
    cols = ", ".join(f"{e} AS n{i}" for i, e in enumerate(n))
    df = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS df{i}" for i in range(len(n)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (1 - 0.75 + 0.75 * dl / mean))" for i in range(len(n)))
    hit = f" {op} ".join(f"n{i} > 0" for i in range(len(n)))
    return f"{_STAT}, c AS (SELECT id, date_sent, len(t) AS dl, {cols} FROM tok), f AS (SELECT {df} FROM c), hits AS (SELECT id, round({score}, 6) AS score FROM c, f, st WHERE ({hit}){extra} ORDER BY score DESC, id LIMIT {k})"


def _words() -> list[str]:
    return ["the", "ther", "anea"]


_SEARCH = " ".join(["ther", "anea", "ntst"])
_FTS = _bm25_sql(["ther", "anea", "ntst"], "AND", 50).replace("hits AS", "ahits AS") + ", hits AS" + _bm25_sql(["ther", "anea", "ntst"], "OR", 50).split("hits AS", 1)[1]
_FTS += ", legs AS (SELECT * FROM ahits WHERE (SELECT count(*) FROM ahits) >= 12 UNION ALL SELECT * FROM hits WHERE (SELECT count(*) FROM ahits) < 12), ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM legs)"
_SNIP = r"substr(regexp_replace(replace(coalesce(content, ''), chr(10), ' '), '^\s+|\s+$', '', 'g'), 1, 240)"
_SHOW = f"SELECT c.id, source_table, source_id, title, {_SNIP} AS snippet, substr(date_sent, 1, 10) AS date, is_bulk, kind"
_DIST = "round(sqrt(list_sum(list_transform(list_zip(v.embedding, s.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6)"
_AGE = "greatest(0.0, (epoch(TIMESTAMP '2025-01-01') - epoch({c}::TIMESTAMP)) / 86400.0)"
_TIERS = "tiers(tier, half, floor) AS (VALUES ('evergreen', -1.0, 1.0), ('warm', 1826.0, 0.05), ('standard', 730.0, 0.05), ('fast', 182.0, 0.05))"
_SCORE = f"""{_TIERS},
c AS (SELECT id, date_sent, CASE source_kind WHEN 'src1' THEN 'fast' WHEN 'src2' THEN 'warm' WHEN 'src3' THEN 'evergreen' ELSE 'standard' END AS tier, {_AGE.format(c="date_sent")} AS age FROM chunks),
r AS (SELECT c.*, CASE WHEN half > 0 THEN ln(2.0) / half ELSE 0 END AS rate, floor FROM c JOIN tiers USING (tier)),
e AS (SELECT r.id, sum(0.1 * exp(-rate * {_AGE.format(c="engaged_at")})) AS boost FROM r JOIN engagements ON chunk_id = r.id GROUP BY r.id),
scored AS (SELECT r.id, tier, round(age, 4) AS age_days, round(greatest(floor, exp(-rate * age) + coalesce(boost, 0)), 6) AS score FROM r LEFT JOIN e ON e.id = r.id)"""
_SESSIONS = "sessions AS (SELECT session_id, min(note_path) AS note_path, min(ts) AS started_at, max(ts) AS ended_at, count(*) FILTER (WHERE event_type = 'change') AS doc_change_count, count(*) FILTER (WHERE event_type <> 'change') AS selection_change_count, count(*) FILTER (WHERE inserted > 0) AS insert_count, count(*) FILTER (WHERE deleted > 0) AS delete_count, CAST(sum(inserted) AS BIGINT) AS total_inserted_chars, CAST(sum(deleted) AS BIGINT) AS total_deleted_chars, count(*) FILTER (WHERE user_event = 'undo') AS undo_count, count(*) FILTER (WHERE user_event = 'input.paste') AS paste_count FROM deltas GROUP BY session_id)"
_RATIO = "round(CASE WHEN coalesce(total_inserted_chars, 0) > 0 THEN total_deleted_chars / total_inserted_chars ELSE 0.0 END, 3) AS rewrite_ratio"


def _vectors(s, p):
    return d.table(s, p, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(s, p):
    return _vectors(s, p).where("id = 3").select("embedding")


def _fts(s, p):
    return search.search(d.chunks(s, p), _SEARCH, k=10, mode="fts")


def _scored(s, p):
    return scoring.scores(d.chunks(s, p), d.engagements(s, p), POLICY, AS_OF)


def _hybrid(s, p):
    return search.search(d.chunks(s, p), _SEARCH, _vectors(s, p), _query_vector(s, p), _scored(s, p), k=10, year_normalize=True)


def _sessions(s, p):
    return writing.sessions(d.deltas(s, p))


def _arc(s, p):
    return writing.writing_arc(_sessions(s, p), "notes/7.md")


def _coverage(s, p):
    line, part, orders = (d.table(s, p, t) for t in ("lineitem", "part", "orders"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    return coverage.matrix(rows.select(F.year("l_shipdate").alias("year"), coverage.classified(F.col("p_type"), F.lit("EmailMessage"), F.col("o_orderpriority"), RULES).alias("domain")), [*DOMAINS, "unclassified"])


DOMAINS = "career fitness health hobbies home money personal programming social".split()
RULES = {"source_kind": {"ECONOMY": "money", "LARGE": "home", "SMALL": "health"}, "schema_type": {}, "sender_domain": {"1-urgent": "career", "5-low": "hobbies"}}
_CELLS = "c AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'money' WHEN 'LARGE' THEN 'home' WHEN 'SMALL' THEN 'health' END, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'career' WHEN '5-low' THEN 'hobbies' END, 'unclassified') AS domain FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT year, domain, count(*) AS n FROM c WHERE year BETWEEN 1980 AND 2030 GROUP BY ALL), dm(domain) AS (VALUES " + ", ".join(f"('{x}')" for x in [*DOMAINS, "unclassified"]) + "), g AS (SELECT y.year, dm.domain, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT year FROM n) y CROSS JOIN dm LEFT JOIN n ON n.year = y.year AND n.domain = dm.domain), cells AS (SELECT year, domain, n, CASE WHEN domain = 'health' THEN 'health' ELSE 'main' END AS scale_group, CASE WHEN max(n) OVER (PARTITION BY domain) = 0 THEN 1.0 ELSE round(1 - n / max(n) OVER (PARTITION BY domain), 4) END AS sparsity FROM g)"
_PART = "customer#00000001"

QUERIES = {
    "q05_postings_bm25": lambda s, p: search.bm25_postings(search.postings(d.chunks(s, p)), search.lengths(d.chunks(s, p)), _words(), 25),
    "q05_bm25_and": lambda s, p: search.bm25_search(d.chunks(s, p), "ther anea", 25, "AND"),
    "q03_bm25_dated": lambda s, p: search.bm25_search(d.chunks(s, p), "ther", 25, "AND", "2016", "2019-06-30"),
    "q04_knn": lambda s, p: search.knn(_vectors(s, p), _query_vector(s, p), 10),
    "q13_nearest_neighbors": lambda s, p: search.nearest_neighbors(_vectors(s, p), 5, 10),
    "q02_rrf": lambda s, p: search.rrf_fuse(search.knn(_vectors(s, p), _query_vector(s, p), 20), search.nearest_neighbors(_vectors(s, p), 5, 20)).select("id", F.round("score", 6).alias("score")),
    "q08_year_counts": lambda s, p: search.year_counts(d.chunks(s, p)),
    "q09_year_weights": lambda s, p: search.year_weights(search.year_counts(d.chunks(s, p))).select("year", "n", F.round("weight", 6).alias("weight")),
    "q12_search": _fts,
    "q12_search_hybrid": _hybrid,
    "q11_typed_counts": lambda s, p: comm.list_sources({"emails": d.emails(s, p), "chat_messages": d.chat_messages(s, p), "conversations_messages": d.conversations_messages(s, p)}, d.chunks(s, p), _vectors(s, p), _files(s, p))["totals"],
    "q15_sources": lambda s, p: comm.list_sources({}, d.chunks(s, p), _vectors(s, p), _files(s, p))["sources"],
    "q15_chunks_embedded": lambda s, p: comm.list_sources({}, d.chunks(s, p), _vectors(s, p), _files(s, p))["chunks"],
    "q17_get_message": lambda s, p: comm.get_message(d.comm(s, p), d.recipients(s, p), None, 42).withColumn("recipients", F.array_join("recipients", ",")),
    "q18_get_thread": lambda s, p: comm.get_thread(d.emails(s, p), thread_id="7"),
    "q18_thread_of_message": lambda s, p: comm.get_thread(d.emails(s, p), msg_id=100),
    "q19_get_conversation": lambda s, p: comm.get_conversation(d.chat_messages(s, p), d.recipients(s, p), d.threads(s, p), "user7", max_messages=100),
    "q20_by_year": lambda s, p: comm.stats_by_year(d.comm(s, p), "2015", None),
    "q20_by_direction": lambda s, p: comm.stats_by_direction(d.comm(s, p)),
    "q20_top_senders": lambda s, p: comm.top_senders(d.comm(s, p)),
    "q22_by_participant": lambda s, p: comm.find_messages_by_participant(d.comm(s, p), d.recipients(s, p), "supplier#00000001", limit=50),
    "q22_by_sender": lambda s, p: comm.find_messages_by_participant(d.comm(s, p), d.recipients(s, p), _PART, "sender", "inbound", "1996", "1999", 50, True),
    "q23_threads_by_subject": lambda s, p: comm.find_threads_by_subject(d.emails(s, p), "urgent", limit=30),
    "q24_top_senders": lambda s, p: comm.top_correspondents(d.comm(s, p), d.recipients(s, p), "sender"),
    "q24_top_recipients": lambda s, p: comm.top_correspondents(d.comm(s, p), d.recipients(s, p), "recipient"),
    "q24_top_both": lambda s, p: comm.top_correspondents(d.comm(s, p), d.recipients(s, p), "both", "1996-01-01", "1998-12-31"),
    "d02_scores": _scored,
    "d04_recompute_fast": lambda s, p: scoring.recomputed(d.chunks(s, p), d.engagements(s, p), POLICY, AS_OF, "fast"),
    "d03_populate": lambda s, p: scoring.populated(d.chunks(s, p), _scored(s, p).where("tier <> 'standard'"), POLICY, AS_OF),
    "a01_tier_summary": lambda s, p: scoring.tier_summary(_scored(s, p)).select("tier", "n", F.round("mean_score", 3).alias("mean_score"), "least", "most"),
    "j04_pending": lambda s, p: embed.pending(d.comm(s, p), d.chunks(s, p).where("id % 2 = 0").select(F.lit("conversations_messages").alias("source_table"), F.col("id").alias("source_id"))).select("source_table", "id"),
    "e07_sessions": _sessions,
    "w1_writing_arc": _arc,
    "w2_session_detail": lambda s, p: writing.session_detail(d.deltas(s, p), "7-20240101"),
    "w3_writing_stats": lambda s, p: writing.writing_stats(_sessions(s, p), "2024-01-01", "2024-01-20"),
    "w3_top_notes": lambda s, p: writing.top_notes(_sessions(s, p)),
    "a12_coverage_matrix": _coverage,
    "a15_coverage_summary": lambda s, p: coverage.summary(_coverage(s, p)),
    "a15_thinnest": lambda s, p: coverage.thinnest(_coverage(s, p)),
    "x_cube": lambda s, p: coverage.cube(d.table(s, p, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("domain"))),
    "d07_chunked": lambda s, p: embed.cut(d.comm(s, p).where("source_table = 'conversations_messages'")),
    "d07_embedded": lambda s, p: embed.embedded(embed.cut(d.conversations_messages(s, p)), embed.hashing_provider(16)),
    "s2_term_lengths": lambda s, p: d.chunks(s, p).select("id", F.size(tokens(F.col("content"))).alias("dl")),
}


def _files(s, p):
    docs = d.table(s, p, "documents")
    return docs.groupBy(F.col("lang").alias("source_org"), F.col("source").alias("source_kind")).agg(F.sum("n_chars").alias("message_count"))


_FILES = "files AS (SELECT lang AS source_org, source AS source_kind, CAST(sum(n_chars) AS BIGINT) AS message_count FROM documents GROUP BY ALL)"
_CORR = "SELECT address, max(name) AS name, count(*) AS message_count FROM ({legs}) GROUP BY address ORDER BY message_count DESC, address NULLS FIRST LIMIT 20"
_SENT = "SELECT sender_address AS address, sender_name AS name FROM comm WHERE is_bulk = 0 AND direction <> 'self'{w}"
_GOT = "SELECT address, CAST(NULL AS VARCHAR) AS name FROM recipients JOIN comm USING (source_table, id) WHERE is_bulk = 0 AND direction <> 'self'{w}"
_W = " AND substr(date_sent, 1, 10) >= '1996-01-01' AND substr(date_sent, 1, 10) <= '1998-12-31'"
_MSG = "source_table, id AS msg_id, substr(date_sent, 1, 10) AS date, date_sent, direction, coalesce(nullif(sender_name, ''), sender_address) AS sender, sender_address, subject, thread_id, is_bulk, matched_via"
_THREAD = "SELECT id AS msg_id, subject, sender_address, sender_name, direction, date_sent, is_bulk, substr(body_text, 1, 300) AS body_preview FROM emails WHERE {w} ORDER BY date_sent NULLS FIRST, msg_id LIMIT 50"
_DELTA = "ts, seq, event_type, user_event, inserted, deleted"
_TOTALS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in (("emails", "emails"), ("chat_messages", "chat_messages"), ("conversations_messages", "conversations_messages"), ("chunks", "chunks"), ("vectors", "embeddings")))

ORACLES = {
    "q05_postings_bm25": with_views("chunks", "WITH " + _bm25_sql(_words(), "OR", 25) + " SELECT * FROM hits"),
    "q05_bm25_and": with_views("chunks", "WITH " + _bm25_sql(["ther", "anea"], "AND", 25) + " SELECT * FROM hits"),
    "q03_bm25_dated": with_views("chunks", "WITH " + _bm25_sql(["ther"], "AND", 25, " AND substr(date_sent, 1, 10) >= '2016' AND substr(date_sent, 1, 10) <= '2019-06-30'") + " SELECT * FROM hits"),
    "q04_knn": f"SELECT *, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) s ORDER BY distance, id LIMIT 10)",
    "q13_nearest_neighbors": f"SELECT *, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 5) s WHERE vec_id <> 5 ORDER BY distance, id LIMIT 10)",
    "q02_rrf": f"WITH a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) s ORDER BY distance, id LIMIT 20)), b AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 5) s WHERE vec_id <> 5 ORDER BY distance, id LIMIT 20)) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id",
    "q08_year_counts": with_views("chunks", "SELECT substr(date_sent, 1, 4) AS year, count(*) AS n FROM chunks GROUP BY 1"),
    "q09_year_weights": with_views("chunks", "WITH y AS (SELECT substr(date_sent, 1, 4) AS year, count(*) AS n FROM chunks GROUP BY 1), m AS (SELECT avg(n) AS mean FROM y) SELECT year, n, round(least(1.0, mean / least(n, 2 * mean)), 6) AS weight FROM y, m"),
    "q12_search": with_views("chunks", f"WITH {_FTS}, best AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM ranked ORDER BY s DESC, id LIMIT 20) {_SHOW}, round_even(s, 5) AS score, 1.0::DOUBLE AS decay_score FROM best JOIN chunks c ON c.id = best.id WHERE coalesce(is_bulk, 0) = 0 AND (kind IS NULL OR kind = 'message') ORDER BY score DESC, c.id LIMIT 10"),
    "q11_typed_counts": with_views("emails chat conv chunks", _TOTALS),
    "q15_sources": f"WITH {_FILES} SELECT source_org, source_kind, count(*) AS files, CAST(sum(message_count) AS BIGINT) AS messages FROM files GROUP BY ALL",
    "q15_chunks_embedded": with_views("chunks", "SELECT source_table, count(*) AS chunks, count(v.vec_id) AS embedded FROM chunks LEFT JOIN embeddings v ON v.vec_id = chunks.id GROUP BY 1"),
    "q17_get_message": with_views("comm recipients", "SELECT m.*, coalesce((SELECT string_agg(address, ',' ORDER BY address) FROM recipients r WHERE r.source_table = m.source_table AND r.id = 42), '') AS recipients FROM (SELECT * FROM comm WHERE id = 42 ORDER BY CASE source_table WHEN 'emails' THEN 0 WHEN 'chat_messages' THEN 1 ELSE 2 END LIMIT 1) m"),
    "q18_get_thread": with_views("emails", _THREAD.format(w="thread_id = '7'")),
    "q18_thread_of_message": with_views("emails", _THREAD.format(w="thread_id = (SELECT thread_id FROM emails WHERE id = 100)")),
    "q19_get_conversation": with_views("chat recipients threads", "WITH who AS (SELECT DISTINCT lower(sender_address) AS address FROM chat_messages WHERE lower(sender_name) LIKE '%user7%' OR lower(sender_address) LIKE '%user7%'), theirs AS (SELECT DISTINCT thread FROM threads t JOIN chat_messages c USING (source_table, id) WHERE lower(c.sender_address) IN (FROM who)), x AS (SELECT source_table, id, 'inbound' AS direction FROM chat_messages WHERE lower(sender_address) IN (FROM who) UNION SELECT c.source_table, c.id, 'outbound' FROM chat_messages c JOIN recipients r USING (source_table, id) WHERE c.direction = 'outbound' AND lower(r.address) IN (FROM who) UNION SELECT c.source_table, c.id, 'outbound' FROM chat_messages c JOIN threads t USING (source_table, id) WHERE c.direction = 'outbound' AND t.thread IN (FROM theirs)) SELECT x.source_table, x.id AS msg_id, x.direction, sender_name, sender_address, date_sent, substr(body_text, 1, 500) AS body_preview FROM x JOIN chat_messages c USING (source_table, id) ORDER BY date_sent DESC NULLS LAST, x.source_table, msg_id, x.direction LIMIT 100"),
    "q20_by_year": with_views("comm", "SELECT substr(date_sent, 1, 4) AS year, count(*) AS messages FROM comm WHERE substr(date_sent, 1, 10) >= '2015' GROUP BY 1"),
    "q20_by_direction": with_views("comm", "SELECT direction, count(*) AS n FROM comm GROUP BY 1"),
    "q20_top_senders": with_views("comm", "SELECT sender_address, count(*) AS n FROM comm WHERE is_bulk = 0 GROUP BY 1 ORDER BY n DESC, sender_address LIMIT 20"),
    "q22_by_participant": with_views("comm recipients", f"WITH m AS (SELECT source_table, id, 'recipient' AS via FROM recipients WHERE lower(address) LIKE '%supplier#00000001%' UNION SELECT source_table, id, 'sender' FROM comm WHERE lower(sender_address) LIKE '%supplier#00000001%' OR lower(sender_name) LIKE '%supplier#00000001%'), v AS (SELECT source_table, id, string_agg(DISTINCT via, ',' ORDER BY via) AS matched_via FROM m GROUP BY ALL) SELECT {_MSG} FROM comm JOIN v USING (source_table, id) WHERE is_bulk = 0 ORDER BY date_sent DESC NULLS LAST, source_table, msg_id LIMIT 50"),
    "q22_by_sender": with_views("comm", f"SELECT {_MSG.replace('matched_via', chr(39) + 'sender' + chr(39) + ' AS matched_via')} FROM comm WHERE (lower(sender_address) LIKE '%{_PART}%' OR lower(sender_name) LIKE '%{_PART}%') AND direction = 'inbound' AND substr(date_sent, 1, 10) >= '1996' AND substr(date_sent, 1, 10) <= '1999' ORDER BY date_sent DESC NULLS LAST, source_table, msg_id LIMIT 50"),
    "q23_threads_by_subject": with_views("emails", "SELECT thread_id, min(subject) AS subject, count(*) AS message_count, min(date_sent) AS date_first, max(date_sent) AS date_last FROM emails WHERE lower(subject) LIKE '%urgent%' OR lower(thread_id) LIKE '%urgent%' GROUP BY 1 ORDER BY date_last DESC NULLS LAST, thread_id LIMIT 30"),
    "q24_top_senders": with_views("comm", _CORR.format(legs=_SENT.format(w=""))),
    "q24_top_recipients": with_views("comm recipients", _CORR.format(legs=_GOT.format(w=""))),
    "q24_top_both": with_views("comm recipients", _CORR.format(legs=_SENT.format(w=_W) + " UNION ALL " + _GOT.format(w=_W))),
    "d02_scores": with_views("chunks engagements", f"WITH {_SCORE} SELECT * FROM scored"),
    "d04_recompute_fast": with_views("chunks engagements", f"WITH {_SCORE} SELECT * FROM scored WHERE tier = 'fast'"),
    "d03_populate": with_views("chunks engagements", f"WITH {_SCORE} SELECT * FROM scored WHERE tier <> 'standard' UNION ALL SELECT id, tier, round(age, 4), round(greatest(floor, exp(-rate * age)), 6) FROM r WHERE tier = 'standard'"),
    "a01_tier_summary": with_views("chunks engagements", f"WITH {_SCORE} SELECT tier, count(*) AS n, round(round(avg(score), 4), 3) AS mean_score, min(score) AS least, max(score) AS most FROM scored GROUP BY 1"),
    "j04_pending": with_views("comm", "SELECT source_table, id FROM comm WHERE coalesce(is_bulk, 0) = 0 AND length(body_text) >= 50 AND NOT (source_table = 'conversations_messages' AND id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0))"),
    "e07_sessions": with_views("deltas", f"WITH {_SESSIONS} SELECT * FROM sessions"),
    "w1_writing_arc": with_views("deltas", f"WITH {_SESSIONS} SELECT *, ended_at - started_at AS duration_ms, {_RATIO} FROM sessions WHERE note_path = 'notes/7.md' ORDER BY started_at DESC NULLS LAST, session_id LIMIT 20"),
    "w2_session_detail": with_views("deltas", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, seq) AS u, row_number() OVER (ORDER BY ts DESC NULLS LAST, seq DESC) AS v FROM deltas WHERE session_id = '7-20240101') SELECT 'first' AS part, CAST(u AS INTEGER) AS position, {_DELTA} FROM r WHERE u <= 10 UNION ALL SELECT 'last', CAST(row_number() OVER (ORDER BY ts NULLS FIRST, seq) AS INTEGER), {_DELTA} FROM r WHERE v <= 10 UNION ALL SELECT 'reversal', CAST(row_number() OVER (ORDER BY ts NULLS FIRST, seq) AS INTEGER), {_DELTA} FROM r WHERE user_event IN ('undo', 'input.paste')"),
    "w3_writing_stats": with_views("deltas", f"WITH {_SESSIONS}, a AS (SELECT count(*) AS session_count, count(DISTINCT note_path) AS notes_touched, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("doc_change_count", "selection_change_count", "insert_count", "delete_count", "total_inserted_chars", "total_deleted_chars", "undo_count", "paste_count")) + f", min(started_at) AS earliest_start, max(coalesce(ended_at, started_at)) AS latest_end FROM sessions WHERE started_at >= epoch_ms(TIMESTAMP '2024-01-01') AND started_at < epoch_ms(TIMESTAMP '2024-01-21')) SELECT *, {_RATIO} FROM a"),
    "w3_top_notes": with_views("deltas", f"WITH {_SESSIONS} SELECT note_path, count(*) AS session_count, CAST(sum(doc_change_count) AS BIGINT) AS doc_change_count, CAST(sum(total_inserted_chars) AS BIGINT) AS total_inserted_chars, CAST(sum(total_deleted_chars) AS BIGINT) AS total_deleted_chars FROM sessions GROUP BY 1 ORDER BY doc_change_count DESC, session_count DESC, note_path LIMIT 10"),
    "a12_coverage_matrix": f"WITH {_CELLS} SELECT * FROM cells",
    "a15_coverage_summary": f"WITH {_CELLS} SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(DISTINCT year) AS years, round(sum(n) FILTER (WHERE domain = 'unclassified') * 100 / sum(n) FILTER (WHERE domain <> 'health'), 1) AS unclassified_pct FROM cells",
    "a15_thinnest": f"WITH {_CELLS} SELECT year, domain, n FROM cells WHERE n > 0 AND domain NOT IN ('health', 'unclassified') ORDER BY n, year, domain LIMIT 10",
    "x_cube": "SELECT CAST(year AS INTEGER) AS year, domain, n FROM (SELECT year(o_orderdate) AS year, o_orderpriority AS domain, count(*) AS n FROM orders GROUP BY CUBE (year(o_orderdate), o_orderpriority))",
    "s2_term_lengths": with_views("chunks", f"SELECT id, CAST(len({_TOK}) AS INTEGER) AS dl FROM chunks"),
}
