"""Queries over chunks with parents of several tables, notes, links and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, values
from tessera.operators import coalesce, comm, embed, graph, history, merge, scoring, search
from tessera.plans import comm_queries as c
from tessera.plans import record_queries as r
from tessera.sources import driver as d
from tessera.sources.driver import with_views


def _documents(s, p):
    null = F.lit(None).cast("string")
    rows = d.chunks(s, p)
    return rows.select("id", F.col("title").alias("subject"), F.col("source_kind").alias("bucket"), F.when(F.col("id") % 3 == 0, F.col("date_sent")).alias("mtime"), null.alias("ctime"), F.col("date_sent").alias("created_at"), "is_bulk")


def _parents(s, p):
    return comm.parents(d.comm(s, p), _documents(s, p))


def _chunks(s, p):
    """Every message and document as a chunk; its id has the table in its last two bits."""
    rank = F.when(F.col("source_table") == "emails", 0).when(F.col("source_table") == "chat_messages", 1).when(F.col("source_table") == "documents", 3).otherwise(2)
    rows = d.comm(s, p).select("source_table", F.col("id").alias("source_id"), F.col("subject").alias("title"), F.col("body_text").alias("content"))
    rows = rows.unionByName(d.chunks(s, p).select("source_table", "source_id", "title", "content"))
    return rows.withColumn("id", F.col("source_id") * 4 + rank).withColumn("metadata", F.when(F.col("source_table") == "chat_messages", F.col("content")))


def _longest(s, p):
    return _chunks(s, p).select("id", F.length("content").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(400)


_CHUNKS = "ch AS (SELECT id * 4 + CASE source_table WHEN 'emails' THEN 0 WHEN 'chat_messages' THEN 1 ELSE 2 END AS id, source_table, id AS source_id, subject AS title, body_text AS content FROM comm UNION ALL SELECT id * 4 + 3, source_table, source_id, title, content FROM chunks)"
_PARENTS = "pa AS (SELECT source_table, id AS source_id, subject, sender_address, sender_name, date_sent, direction, thread_id, is_bulk, kind FROM comm UNION ALL SELECT 'documents', id, title, NULL, source_kind, date_sent, NULL, NULL, is_bulk, NULL FROM chunks)"


def _notes(s, p):
    k = F.col("doc_id")
    return d.table(s, p, "documents").select(k.alias("id"), F.concat(F.lit("notes/"), k, F.lit(".md")).alias("file_path"), F.concat(F.lit("note "), k).alias("name"), F.col("lang").alias("description"), F.col("text").alias("body"), F.when(k % 5 == 0, "deleted").otherwise("live").alias("status"), F.col("source").alias("at_type"), (k % 97).cast("string").alias("updated_at"))


_NOTES = "notes AS (SELECT doc_id AS id, 'notes/' || doc_id || '.md' AS file_path, 'note ' || doc_id AS name, lang AS description, text AS body, CASE WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'live' END AS status, source AS at_type, CAST(doc_id % 97 AS VARCHAR) AS updated_at FROM documents), chunks AS (SELECT id, CAST(NULL AS VARCHAR) AS date_sent, concat_ws(chr(10), name, description, body) AS content FROM notes)"
_TERMS = ["ther", "anea"]
_BARE = r"list_contains(['ther', 'anea'], regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g'))"
_EXCERPT = f"""n AS (SELECT id, file_path, name, list_filter(string_split_regex(body, '[ \\t\\n\\f\\r\\x{{0B}}]+'), lambda x: x <> '') AS w FROM notes),
m AS (SELECT *, greatest(1, coalesce(list_position(list_transform(w, lambda x: {_BARE}), true), 0) - 10) AS a FROM n),
shown AS (SELECT id, file_path, name, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(list_transform(w[a:a + 39], lambda x: CASE WHEN {_BARE} THEN '»' || x || '«' ELSE x END), ' ') || CASE WHEN len(w) > a + 39 THEN '…' ELSE '' END AS snippet FROM m)"""


def _links(s, p):
    return r._dissolutions(s, p).select("dissolution_id", "file_path", "commit_sha").distinct()


def _with_priors(s, p):
    """Revisions, of which those of authors 'ai' that modify are renames from another path."""
    moved = (F.col("change_type") == "modify") & (F.col("authorship") == "ai-coauthored")
    return d.revisions(s, p).withColumns({"prior_file_path": F.when(moved, F.col("file_path")), "change_type": F.when(moved, "rename").otherwise(F.col("change_type"))})


def _reclassified(s, p):
    revisions = _with_priors(s, p)
    return history.reclassified(_links(s, p), revisions, "wave", ["vault/12%.md", "vault/7_.md"]).groupBy("dissolution_id").agg(F.count("*").alias("n")).where("dissolution_id = 'wave' or n > 1")


def _subjects(s, p):
    return d.revisions(s, p).select("commit_sha").distinct().withColumn("subject", F.when(F.col("commit_sha").like("1%"), "Dissolve the folder").otherwise("notes"))


def _migrations(s, p):
    return r._dissolutions(s, p).withColumn("migration_id", F.when(F.col("reason") != "", F.col("commit_sha")))


def _web_pages(s, p):
    k = F.col("page_id")
    return d.table(s, p, "pages").select(k.alias("id"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.when(k % 2 == 0, "an excerpt of the page").alias("excerpt"), F.lit("d").alias("domain"), F.lit("2020").alias("last_seen"))


def _bookmarks(s, p):
    """Three bookmarks of every page: with a note, with highlights and tags, and an excluded one."""
    rows = d.table(s, p, "pages").select(F.col("page_id").alias("web_page_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    text_of = lambda what: F.concat(F.lit(f"{what} "), "web_page_id", F.lit("."), "n")
    return rows.select("web_page_id", (F.col("web_page_id") * 3 + F.col("n")).alias("id"), F.when(F.col("n") != 1, text_of("note")).alias("note"), F.when(F.col("n") == 1, text_of("mark")).alias("highlights"), F.when(F.col("n") == 1, F.lit('["a","b c"]')).otherwise("[]").alias("tags"), (F.col("n") == 2).alias("excluded"))


def _old_chunks(s, p):
    return d.table(s, p, "pages").where("page_id % 4 = 3").select(F.lit("web_pages").alias("source_table"), F.col("page_id").alias("source_id"))


def _audit_log(s, p):
    people = d.people(s, p)
    log = coalesce.audit_log(people, "id", r._proposals(s, p), "people")
    return log.select("facet_type", "facet_node_id", "rule", "confidence", "merged_id", F.get_json_object("payload", "$.full_name").alias("full_name"))


def _qualified(s, p):
    t, _, _ = r._graph(s, p)
    base = t.select(F.col("id").alias("triple_id"), F.col("predicate").alias("key"), F.lit("old").alias("value"))
    both = graph.with_qualifiers(base, t.where("predicate = 'childOf'").select(F.col("id").alias("triple_id"), F.col("predicate").alias("key"), F.lit("new").alias("value")))
    return both.groupBy("key", "value").agg(F.count("*").alias("n"))


def _info(s, p):
    tables = {"emails": d.emails(s, p), "chat_messages": d.chat_messages(s, p), "conversations_messages": d.conversations_messages(s, p)}
    return comm.server_info(tables, d.chunks(s, p), d.table(s, p, "embeddings"))


QUERIES = {
    "q07_hydrate": lambda s, p: search.hydrated(_longest(s, p), _chunks(s, p), _parents(s, p), 40),
    "q14_get_chunk": lambda s, p: comm.get_chunk(_chunks(s, p), _parents(s, p), 169).withColumn("metadata", F.element_at("metadata", "k")),
    "q16_server_info": _info,
    "d05_content_dates": lambda s, p: scoring.content_dates(_chunks(s, p), _parents(s, p)).groupBy("source_table", F.substring("date_sent", 1, 7).alias("month")).agg(F.count("*").alias("n")),
    "d05_source_kinds": lambda s, p: scoring.source_kinds(_chunks(s, p), _chunks(s, p).select("source_table", "source_id", (F.col("source_id") % 5).alias("source_file_id")), s.createDataFrame([(i, f"kind{i % 3}") for i in range(4)], "id long, source_kind string")).groupBy("source_table", F.coalesce("source_kind", F.lit("none")).alias("source_kind")).agg(F.count("*").alias("n")),
    "d06_record_engagement": lambda s, p: scoring.recorded(d.engagements(s, p), [3, 3, 17], "opened", "2024-06-01T00:00:00", "cli").groupBy("chunk_id", F.coalesce("event_type", F.lit("view")).alias("event_type")).agg(F.count("*").alias("n"), F.max("engaged_at").alias("last")),
    "v01_note_search": lambda s, p: history.note_search(_notes(s, p), " ".join(_TERMS), 20),
    "v01_list_notes": lambda s, p: history.list_notes(_notes(s, p), "live", "src1", 30).select("id", "file_path", "updated_at"),
    "v01_lookup": lambda s, p: history.note_lookup(_notes(s, p), "note 8").select("id", "file_path", "name"),
    "v01_renamed": lambda s, p: history.renamed(_notes(s, p), _notes(s, p).where("id % 10 = 1").select(F.col("file_path").alias("old_path"), F.concat(F.lit("moved/"), "id").alias("new_path"))).select("id", "file_path"),
    "r01_materialized": lambda s, p: history.materialized(d.revisions(s, p), d.revisions(s, p).select("commit_sha", "file_path", F.col("change_type").alias("body")).distinct(), "vault/1.md"),
    "p04_under_paths": lambda s, p: history.under_paths(_with_priors(s, p), ["vault/12%.md", "vault/7_.md"]).groupBy("change_type").agg(F.count("*").alias("n")),
    "l04_reclassified": _reclassified,
    "l05_detected": lambda s, p: history.detected(d.revisions(s, p), _subjects(s, p)).groupBy("signal").agg(F.count("*").alias("n"), F.sum("files").alias("files")),
    "a09_overview": lambda s, p: history.overview(d.revisions(s, p), _migrations(s, p), _links(s, p), r._materializations(s, p)),
    "j03_web_page_texts": lambda s, p: embed.web_page_texts(_web_pages(s, p), _bookmarks(s, p), _old_chunks(s, p)),
    "c04_audit_log": _audit_log,
    "g07_qualifiers": _qualified,
    "f_json": lambda s, p: d.table(s, p, "events").select("event_id", values.json_text(F.col("props"), "$.k").alias("k"), values.json_text(F.col("props"), "$.none").alias("none"), F.element_at(values.json_map(F.col("props")), "k").alias("from_map"), text.tag_list(F.concat(F.lit('["'), "event_type", F.lit('","x"]'))).alias("tags")),
    "s06_manifest": lambda s, p: merge.manifest({n: d.table(s, p, n) for n in ("region", "nation", "orders", "lineitem")}),
    "s05_after_watermark": lambda s, p: merge.after_watermark(d.table(s, p, "events").select("event_id", "user_id", "ts"), merge.watermarks(d.table(s, p, "events").where("event_id % 3 <> 0"), "user_id", "event_id"), "user_id", "event_id").groupBy("user_id").agg(F.count("*").alias("n")),
}

_PEOPLE = "WITH RECURSIVE " + with_views("people", "SELECT 1")[5:].rsplit(" SELECT 1", 1)[0] + f", {r._KEYS}, cc(x, y) AS (SELECT id, id FROM people UNION SELECT cc.x, e.y FROM cc JOIN e ON e.x = cc.y), m AS (SELECT x, min(y) AS y FROM cc GROUP BY x), ph AS (SELECT DISTINCT m.y FROM (SELECT id, k, count(*) OVER (PARTITION BY k) AS n FROM k) t JOIN m ON m.x = t.id WHERE n > 1 AND k LIKE 'p%'), prop AS (SELECT x AS id, m.y AS survivor, CASE WHEN ph.y IS NULL THEN 'discord_handle' ELSE 'phone_e164' END AS rule, CASE WHEN ph.y IS NULL THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CASE WHEN ph.y IS NULL THEN 'review' ELSE 'auto' END AS decision FROM m LEFT JOIN ph ON ph.y = m.y WHERE m.y < x)"
_PRIORS = "rv AS (SELECT * REPLACE (CASE WHEN change_type = 'modify' AND authorship = 'ai-coauthored' THEN 'rename' ELSE change_type END AS change_type), CASE WHEN change_type = 'modify' AND authorship = 'ai-coauthored' THEN file_path END AS prior_file_path FROM revisions), un AS (SELECT * FROM rv WHERE (change_type = 'delete' AND (file_path LIKE 'vault/12%.md' OR file_path LIKE 'vault/7_.md')) OR (change_type = 'rename' AND (prior_file_path LIKE 'vault/12%.md' OR prior_file_path LIKE 'vault/7_.md')))"
_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))

ORACLES = {
    "q07_hydrate": with_views("comm chunks", f"WITH {_CHUNKS}, {_PARENTS}, top AS (SELECT id, length(content)::DOUBLE AS score FROM ch ORDER BY score DESC, id LIMIT 400) SELECT ch.id, ch.source_table, ch.source_id, score, coalesce(subject, title) AS subject, sender_address, sender_name, substr(date_sent, 1, 10) AS date, direction, thread_id, is_bulk, kind, {c._SNIP.replace('240', '40')} AS snippet FROM top JOIN ch USING (id) LEFT JOIN pa ON pa.source_table = ch.source_table AND pa.source_id = ch.source_id"),
    "q14_get_chunk": with_views("comm chunks", f"WITH {_CHUNKS}, {_PARENTS} SELECT ch.id, ch.source_table, ch.source_id, content, subject, sender_address, date_sent, direction, json_extract_string(content, '$.k') AS metadata FROM ch LEFT JOIN pa USING (source_table, source_id) WHERE ch.id = 169"),
    "q16_server_info": "SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors",
    "d05_content_dates": with_views("comm chunks", f"WITH {_CHUNKS}, {_PARENTS} SELECT source_table, substr(coalesce(date_sent, ''), 1, 7) AS month, count(*) AS n FROM ch LEFT JOIN pa USING (source_table, source_id) GROUP BY ALL"),
    "d05_source_kinds": with_views("comm chunks", f"WITH {_CHUNKS} SELECT source_table, CASE WHEN source_id % 5 < 4 THEN 'kind' || (source_id % 5) % 3 ELSE 'none' END AS source_kind, count(*) AS n FROM ch GROUP BY ALL"),
    "d06_record_engagement": with_views("engagements", "SELECT chunk_id, event_type, count(*) AS n, max(engaged_at) AS last FROM (SELECT chunk_id, engaged_at, 'view' AS event_type FROM engagements UNION ALL SELECT * FROM (VALUES (3, '2024-06-01T00:00:00', 'opened'), (3, '2024-06-01T00:00:00', 'opened'), (17, '2024-06-01T00:00:00', 'opened'))) GROUP BY ALL"),
    "v01_note_search": f"WITH {_NOTES}, {c._bm25_sql(_TERMS, 'AND', 20)}, {_EXCERPT} SELECT id, file_path, name, score, snippet FROM hits JOIN shown USING (id)",
    "v01_list_notes": f"WITH {_NOTES} SELECT id, file_path, updated_at FROM notes WHERE status = 'live' AND at_type = 'src1' ORDER BY updated_at DESC, file_path LIMIT 30",
    "v01_lookup": f"WITH {_NOTES} SELECT id, file_path, name FROM notes WHERE name = 'note 8'",
    "v01_renamed": "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'moved/' || doc_id ELSE 'notes/' || doc_id || '.md' END AS file_path FROM documents",
    "r01_materialized": with_views("revisions", "SELECT file_path, commit_sha, captured_at, change_type AS body FROM (SELECT * FROM revisions WHERE file_path = 'vault/1.md' ORDER BY captured_at DESC, commit_sha DESC LIMIT 1) WHERE change_type <> 'delete'"),
    "p04_under_paths": with_views("revisions", f"WITH {_PRIORS} SELECT change_type, count(*) AS n FROM un GROUP BY 1"),
    "l04_reclassified": with_views("revisions", f"WITH {_PRIORS} SELECT 'wave' AS dissolution_id, count(*) AS n FROM (SELECT DISTINCT file_path, commit_sha FROM un)"),
    "l05_detected": with_views("revisions", "SELECT signal, count(*) AS n, CAST(sum(files) AS BIGINT) AS files FROM (SELECT commit_sha, count(DISTINCT file_path) AS files, CASE WHEN commit_sha LIKE '1%' THEN 'subject_keyword' WHEN count(DISTINCT file_path) >= 10 THEN 'bulk_delete' END AS signal FROM revisions WHERE change_type = 'delete' GROUP BY 1) WHERE signal IS NOT NULL GROUP BY 1"),
    "a09_overview": with_views("revisions", f"WITH {r._DISS}, au AS ({r.ORACLES['l03_audit'].split(f'WITH {r._DISS} ', 1)[-1] if f'WITH {r._DISS} ' in r.ORACLES['l03_audit'] else r.ORACLES['l03_audit'].split(r._DISS, 1)[1].lstrip()}) SELECT count(*) AS dissolutions, count(*) FILTER (WHERE reason = '') AS without_migration, (SELECT count(*) FROM (SELECT DISTINCT dissolution_id, file_path, commit_sha FROM dissolutions)) AS linked_revisions, (SELECT count(*) FROM orders) AS materializations, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM au WHERE severity = 'error') AS audit_errors, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM au WHERE severity = 'warning') AS audit_warnings, (SELECT coalesce(sum(n), 0) = 0 FROM au WHERE severity = 'error') AS audit_pass FROM dissolutions"),
    "j03_web_page_texts": "WITH p AS (SELECT page_id AS id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, CASE WHEN page_id % 2 = 0 THEN 'an excerpt of the page' END AS excerpt FROM pages WHERE page_id % 4 <> 3) SELECT 'web_pages' AS source_table, id, title AS subject, coalesce(title, '') || chr(10) || coalesce(excerpt, '') || chr(10) || 'note ' || id || '.0' || chr(10) || 'mark ' || id || '.1' || chr(10) || 'a, b c' AS body_text, 'd' AS domain, '2020' AS last_seen FROM p WHERE length(coalesce(title, '') || coalesce(excerpt, '') || 'note ' || id || '.0') >= 50",
    "c03_people_proposals": f"{_PEOPLE} SELECT * FROM prop",
    "c10_merge_stats": f"{_PEOPLE} SELECT rule, CASE WHEN confidence >= 0.95 THEN '>=0.95' ELSE '0.80-0.90' END AS bucket, count(*) AS n FROM prop GROUP BY ALL",
    "c04_audit_log": f"{_PEOPLE} SELECT 'people' AS facet_type, survivor AS facet_node_id, rule, confidence, prop.id AS merged_id, full_name FROM prop JOIN people ON people.id = prop.id",
    "g07_qualifiers": f"WITH {r._STATEMENTS} SELECT predicate AS key, CASE WHEN predicate = 'childOf' THEN 'new' ELSE 'old' END AS value, count(*) AS n FROM (SELECT DISTINCT subject_kind, lower(subject) AS s, predicate, object_kind, lower(object) AS o, provenance FROM statements) GROUP BY ALL",
    "g09_bookmark_statements": rf"WITH p AS (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages), s AS (SELECT url, 'relatesTo' AS predicate, 'domain' AS object_kind, domain AS object FROM p UNION SELECT url, 'taggedWith', 'tag', unnest(['t', 'u']) FROM p UNION SELECT url, 'inFolder', 'folder', 'f' FROM p UNION SELECT url, 'mentions', 'concept', w FROM (SELECT url, unnest(regexp_extract_all(lower(title), '[a-z][a-z0-9\-]{{2,}}')) AS w FROM p) WHERE w NOT IN ({_STOP})) SELECT DISTINCT 'web_page' AS subject_kind, url AS subject, predicate, object_kind, object, 'bookmark' AS provenance, url AS ref FROM s WHERE object <> ''",
    "k06_snapshot": f"SELECT label, printf('%.4f', readiness) AS readiness, '{r.AS_OF}' AS computed_at FROM ({r.ORACLES['k01_readiness']}) WHERE readiness IS NOT NULL",
    "f_json": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none, json_extract_string(props, '$.k') AS from_map, event_type || ', x' AS tags FROM events",
    "s06_manifest": "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
    "s05_after_watermark": "WITH w AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 3 <> 0 GROUP BY 1) SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN w USING (user_id) WHERE m IS NULL OR event_id > m GROUP BY 1",
    "q12_search_hybrid": with_views(
        "chunks engagements",
        f"""WITH sc AS (WITH {c._SCORE} SELECT * FROM scored), rk AS (WITH {c._FTS} SELECT id, rank FROM ranked),
kn AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT v.vec_id AS id, {c._DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) s ORDER BY distance, id LIMIT 50)),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM kn UNION ALL SELECT * FROM rk) GROUP BY id ORDER BY s DESC, id LIMIT 20),
yc AS (SELECT substr(date_sent, 1, 4) AS year, count(*) AS n FROM chunks WHERE length(date_sent) >= 4 GROUP BY 1), ym AS (SELECT avg(n) AS mean FROM yc),
yw AS (SELECT year, least(1.0::DOUBLE, mean / least(n::DOUBLE, 2 * mean)) AS weight FROM yc, ym),
best AS (SELECT f.id, s * coalesce(weight, 1.0) * coalesce(sc.score, 1.0) AS s, coalesce(sc.score, 1.0) AS ds FROM fused f JOIN chunks ON chunks.id = f.id LEFT JOIN yw ON yw.year = substr(date_sent, 1, 4) LEFT JOIN sc ON sc.id = f.id)
{c._SHOW}, round_even(s, 5) AS score, round_even(ds, 4) AS decay_score FROM best JOIN chunks c ON c.id = best.id WHERE coalesce(is_bulk, 0) = 0 AND (kind IS NULL OR kind = 'message') ORDER BY score DESC, c.id LIMIT 10""",
    ),
}
