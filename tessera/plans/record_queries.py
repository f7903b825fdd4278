"""Graph, merge, identity, history and skill queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, urls
from tessera.operators import coalesce, graph, history, merge, skills
from tessera.operators.components import components
from tessera.sources import driver as d
from tessera.sources.driver import with_views

AS_OF = "2002-01-01 00:00:00"


def _statements(s, p):
    """Nations in regions, customers and suppliers in nations, and messages' recipients and threads of customers' orders."""
    n, r, c, sup = (d.table(s, p, t) for t in ("nation", "region", "customer", "supplier"))
    null = F.lit(None).cast("string")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("nation").alias("subject_kind"), F.col("n_name").alias("subject"), F.lit("childOf").alias("predicate"), F.lit("region").alias("object_kind"), F.col("r_name").alias("object"), F.lit("geo").alias("provenance"), null.alias("ref"))
    of = lambda t, name, key, kind: t.join(n, t[key] == n.n_nationkey).select(F.lit(kind).alias("subject_kind"), F.col(name).alias("subject"), F.lit("partOf").alias("predicate"), F.lit("nation").alias("object_kind"), F.col("n_name").alias("object"), F.lit(kind).alias("provenance"), null.alias("ref"))
    lone = c.where("c_custkey % 100 = 0").select(F.lit("customer").alias("subject_kind"), F.col("c_name").alias("subject"), F.lit("mentions").alias("predicate"), F.lit("concept").alias("object_kind"), null.alias("object"), F.lit("none").alias("provenance"), null.alias("ref"))
    return geo.union(of(c, "c_name", "c_nationkey", "customer")).union(of(sup, "s_name", "s_nationkey", "supplier")).union(lone)


_STATEMENTS = "statements AS (SELECT 'nation' AS subject_kind, n_name AS subject, 'childOf' AS predicate, 'region' AS object_kind, r_name AS object, 'geo' AS provenance FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customer', c_name, 'partOf', 'nation', n_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', s_name, 'partOf', 'nation', n_name, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer', c_name, 'mentions', 'concept', NULL, 'none' FROM customer WHERE c_custkey % 100 = 0)"


def _graph(s, p):
    st = _statements(s, p)
    mentions = st.select(F.col("subject_kind").alias("kind"), F.col("subject").alias("label")).union(st.where("object is not null").select("object_kind", "object"))
    known = graph.predicates(s)
    return graph.add_triples(st, known), graph.resolve_nodes(mentions), known


def _triples(s, p):
    t, n, _ = _graph(s, p)
    return graph.statements_of(t, n).select("subject_kind", "subject", "predicate", "object_kind", "object", "provenance")


def _sightings(s, p):
    """Pages seen by two instruments; normalisation brings some together."""
    k = F.col("page_id")
    url = d.table(s, p, "pages").select(k, F.regexp_replace("url", r"/\d+(\.html)?", "").alias("url"))
    one = url.select(urls.normalize_url(F.col("url")).alias("normalized_url"), "url", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("title "), k)).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("excerpt "), k)).alias("excerpt"), F.concat(F.lit("2020-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("seen"), k.alias("seq"), F.when(k % 2 == 0, "one").otherwise("two").alias("instrument"))
    return one


_SIGHTINGS = rf"u AS (SELECT page_id, regexp_replace(url, '/\d+(\.html)?', '') AS url FROM pages), v AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:'), '\?utm_source=feed$', '') AS a FROM u), sightings AS (SELECT CASE WHEN contains(a, '?') THEN regexp_replace(a, '/+\?', '?') ELSE regexp_replace(a, '/+$', '') END AS normalized_url, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'title ' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN 'excerpt ' || page_id END AS excerpt, '2020-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS seen, page_id AS seq, CASE WHEN page_id % 2 = 0 THEN 'one' ELSE 'two' END AS instrument FROM v)"


def _appearances(s, p):
    o, c = d.table(s, p, "orders"), d.table(s, p, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_custkey").alias("key"), F.concat_ws(" ", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("friends_since"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("export"))


_APPEARANCES = "appearances AS (SELECT c_custkey AS key, c_name || ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS friends_since, strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS export FROM orders JOIN customer ON o_custkey = c_custkey)"


def _updates(s, p):
    o = d.table(s, p, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("b"))


def _dissolutions(s, p):
    r = d.revisions(s, p).where("change_type = 'delete' and authorship = 'owner-authored'")
    return r.select("file_path", "commit_sha", F.concat(F.lit("d-"), "commit_sha").alias("dissolution_id"), F.col("captured_at").alias("dissolved_at"), F.when(F.col("size_bytes") % 400 == 0, "done").otherwise("").alias("reason"), F.when(F.col("size_bytes") > 5000, "[]").otherwise('["t"]').alias("target_tables")).distinct()


def _materializations(s, p):
    return d.table(s, p, "orders").select(F.concat(F.lit("vault/"), "o_orderkey", F.lit(".md")).alias("file_path"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("materialized_at"), F.col("o_orderkey").alias("run_id"))


_DISS = "dissolutions AS (SELECT DISTINCT file_path, commit_sha, 'd-' || commit_sha AS dissolution_id, captured_at AS dissolved_at, CASE WHEN size_bytes % 400 = 0 THEN 'done' ELSE '' END AS reason, CASE WHEN size_bytes > 5000 THEN '[]' ELSE '[\"t\"]' END AS target_tables FROM revisions WHERE change_type = 'delete' AND authorship = 'owner-authored'), materializations AS (SELECT 'vault/' || o_orderkey || '.md' AS file_path, strftime(o_orderdate, '%xT%X') AS materialized_at, o_orderkey AS run_id FROM orders)"
_NOTES = "notes AS (SELECT repo, file_path, arg_max(change_type, captured_at || commit_sha) AS last_change, max(captured_at) AS modified_at, min(captured_at) AS created_at, max(captured_at) FILTER (WHERE change_type = 'add') AS last_added_at, max(captured_at) FILTER (WHERE change_type = 'delete') AS last_deleted_at, count(*) AS revisions FROM revisions GROUP BY ALL), states AS (SELECT n.*, CASE WHEN last_change <> 'delete' THEN 'active' WHEN n.file_path IN (SELECT file_path FROM dissolutions) THEN 'dissolved' ELSE 'deleted' END AS status FROM notes n)"


def _states(s, p):
    return history.note_states(history.notes(d.revisions(s, p)), _dissolutions(s, p))


def _disciplines(s, p):
    n, o, c = (d.table(s, p, t) for t in ("nation", "orders", "customer"))
    last = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("last"))
    k = F.col("n_nationkey")
    return n.join(last, n.n_nationkey == last.c_nationkey, "left").select(F.col("n_name").alias("label"), F.when(k % 4 != 0, F.round(k / 25, 4)).alias("readiness"), F.when(k % 5 != 0, F.col("last")).alias("last_verified"), F.when(k % 3 != 0, F.lit(0.8)).alias("baseline"), F.concat(F.lit("200"), k % 2, F.lit("-06-01")).alias("asserted_at"))


_DISC = "disciplines AS (SELECT n_name AS label, CASE WHEN n_nationkey % 4 <> 0 THEN round(n_nationkey / 25, 4) END AS readiness, CASE WHEN n_nationkey % 5 <> 0 THEN last END AS last_verified, CASE WHEN n_nationkey % 3 <> 0 THEN 0.8 END AS baseline, '200' || (n_nationkey % 2) || '-06-01' AS asserted_at FROM nation LEFT JOIN (SELECT c_nationkey, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) x ON c_nationkey = n_nationkey)"


def _prerequisites(s, p):
    n = d.table(s, p, "nation")
    a, b = n.select(F.col("n_name").alias("subject"), F.col("n_nationkey").alias("x")), n.select(F.col("n_name").alias("object"), F.col("n_nationkey").alias("y"))
    return a.join(b, (F.col("y") == F.col("x") * 2) | (F.col("y") == F.col("x") + 7)).where("x <> y").select("subject", "object")


_PRE = "prerequisites AS (SELECT a.n_name AS subject, b.n_name AS object FROM nation a JOIN nation b ON (b.n_nationkey = a.n_nationkey * 2 OR b.n_nationkey = a.n_nationkey + 7) AND a.n_nationkey <> b.n_nationkey)"


def _practice(s, p):
    o, c, n = (d.table(s, p, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


def _frontier(s, p):
    return skills.frontier(_disciplines(s, p), _prerequisites(s, p), AS_OF, 0.3, 60)


_FRONT = f"{_DISC}, {_PRE}, rs AS (SELECT *, CASE WHEN readiness IS NULL THEN 'unaddressed' WHEN last_verified IS NULL OR last_verified < TIMESTAMP '2002-01-01' - INTERVAL 60 DAY THEN 'under-informed' WHEN readiness < 0.3 THEN 'below-threshold' END AS reason FROM disciplines), gate AS (SELECT object AS label, bool_or(coalesce(readiness >= 0.3, FALSE)) AS ok FROM prerequisites LEFT JOIN disciplines ON label = subject GROUP BY 1), frontier AS (SELECT rs.label, reason FROM rs LEFT JOIN gate ON gate.label = rs.label WHERE reason IS NOT NULL AND (reason = 'below-threshold' OR coalesce(ok, TRUE)))"


def _actions(s, p):
    part = d.table(s, p, "part")
    k = F.col("p_partkey")
    n = d.table(s, p, "nation")
    return part.join(n, (k % 25) == n.n_nationkey).select(F.col("n_name").alias("label"), F.concat(F.lit("a"), k).alias("action"), (k % 10).alias("est_value"), (k % 7).alias("cost"), (k % 3).alias("novelty"), ((k % 4 + 1) / 4).alias("p_action"))


_ACT = "actions AS (SELECT n_name AS label, 'a' || p_partkey AS action, p_partkey % 10 AS est_value, p_partkey % 7 AS cost, p_partkey % 3 AS novelty, (p_partkey % 4 + 1) / 4 AS p_action FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"


def _copies(s, p):
    docs = d.table(s, p, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content"))
    return coalesce.candidate_pairs(docs, (coalesce.Rule("exact_content", "exact_field", ("content",), 0.99),)).select("a", "b", "rule", "confidence")


def _proposals(s, p):
    return coalesce.proposals(d.people(s, p), coalesce.PEOPLE, 0.8)


_KEYS = "k AS (SELECT id, 'p' || phone AS k FROM people WHERE phone IS NOT NULL UNION ALL SELECT id, 'd' || discord_handle FROM people WHERE discord_handle IS NOT NULL), e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b USING (k) WHERE a.id <> b.id)"
_HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


def _places(s, p):
    return coalesce.candidate_pairs(d.places(s, p), coalesce.PLACES[:1]).select("a", "b", "rule", "confidence")


def _year_edges(s, p):
    o = d.table(s, p, "orders")
    return components(o.select((F.col("o_custkey") + 1_000_000).alias("a"), (F.month("o_orderdate") * 100 + F.year("o_orderdate") % 100).cast("long").alias("b")))


QUERIES = {
    "g03_triples": _triples,
    "g01_nodes": lambda s, p: _graph(s, p)[1].select("kind", "label", "normalized_label"),
    "g04_query_triples": lambda s, p: graph.query_triples(*_graph(s, p), object_="NATION_3", predicate="partOf", limit=None).select("direction", "subject_kind", "subject", "predicate", "object"),
    "g05_with_inverse": lambda s, p: graph.query_triples(*_graph(s, p), subject="NATION_3", include_inverse=True, limit=None).select("direction", "subject", "predicate", "object_kind", "object"),
    "g06_neighborhood": lambda s, p: graph.neighborhood(*_graph(s, p)[:2], "nation", "nation_3", 60),
    "g07_predicates": lambda s, p: graph.predicates(s).where("name in ('childOf', 'relatesTo', 'sentTo')"),
    "g06_reachable": lambda s, p: _reach(s, p),
    "a06_graph_totals": lambda s, p: graph.stats(*_graph(s, p))["totals"],
    "a06_graph_usage": lambda s, p: graph.stats(*_graph(s, p))["usage"].where("n > 0"),
    "a06_graph_kinds": lambda s, p: graph.stats(*_graph(s, p))["kinds"],
    "g10_message_statements": lambda s, p: graph.message_statements(d.recipients(s, p), d.threads(s, p)).groupBy("predicate", "provenance").agg(F.count("*").alias("n"), F.countDistinct("object").alias("objects")),
    "g09_bookmark_statements": lambda s, p: graph.bookmark_statements(d.table(s, p, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), urls.domain(F.col("url")).alias("domain"), F.array(F.lit("t"), F.lit("u")).alias("tags"), F.lit("f").alias("folder")), text.concepts),
    "k07_depths": lambda s, p: graph.depths(d.table(s, p, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.floor((F.col("n_nationkey") - 1) / 3).cast("int").alias("parent"))),
    "e02_web_pages": lambda s, p: merge.web_pages(_sightings(s, p)),
    "e03_bookmarks": lambda s, p: merge.bookmarks(_sightings(s, p)),
    "e01_last_known": lambda s, p: merge.last_known(_updates(s, p), "key", "seq"),
    "e04_new_rows": lambda s, p: merge.new_rows(d.table(s, p, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), d.table(s, p, "lineitem").where("l_orderkey % 2 = 0").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey"),
    "e05_connections": lambda s, p: merge.connections(_appearances(s, p)).withColumn("exports", F.size("exports")),
    "e06_inactive": lambda s, p: merge.with_inactive(merge.connections(_appearances(s, p)), "1998-08-02#000000001").groupBy("status").agg(F.count("*").alias("n")),
    "s06_row_loss": lambda s, p: merge.row_loss(d.table(s, p, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")), d.table(s, p, "lineitem").where("l_returnflag <> 'R' or l_linenumber > 2").groupBy(F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n"))),
    "u01_normalize_url": lambda s, p: d.table(s, p, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"), urls.domain(F.col("url")).alias("domain"), F.coalesce(urls.junk(F.col("url")), urls.skip(F.col("url")), F.lit("ok")).alias("verdict")),
    "c01_exact_copies": _copies,
    "c03_people_components": lambda s, p: _proposals(s, p).select("id", "survivor"),
    "c03_people_proposals": _proposals,
    "c06_places_near": _places,
    "c10_merge_stats": lambda s, p: coalesce.merge_stats(_proposals(s, p)),
    "c04_applied": lambda s, p: coalesce.applied(d.people(s, p).select("id"), "id", _proposals(s, p)).groupBy("id").agg(F.count("*").alias("n")),
    "x_components": _year_edges,
    "r01_revisions": lambda s, p: history.revisions_of(d.revisions(s, p), since="2000", change_type="delete", limit=40),
    "n02_latest_revision": lambda s, p: history.latest(d.revisions(s, p)).select("file_path", "commit_sha", "captured_at"),
    "a07_revision_stats": lambda s, p: history.stats(d.revisions(s, p)),
    "a07_summary_coverage": lambda s, p: history.summary_coverage(d.revisions(s, p)),
    "a07_top_files": lambda s, p: history.top_files(d.revisions(s, p)),
    "a07_by_day": lambda s, p: history.by_day(d.revisions(s, p)),
    "r03_summary_queue": lambda s, p: history.summary_queue(d.revisions(s, p).dropDuplicates(["commit_sha"])).select("commit_sha", "model", "bundle"),
    "r04_skipped": lambda s, p: history.skipped(d.revisions(s, p), ["VAULT/1%.md"]).groupBy(F.coalesce("summary", F.lit("none")).alias("summary")).agg(F.count("*").alias("n")),
    "k03_authorship": lambda s, p: history.with_authorship(d.revisions(s, p), d.revisions(s, p).where("size_bytes % 3 = 0").select("commit_sha", "authorship").dropDuplicates(["commit_sha"]), s.createDataFrame([("repo", "ai-generated")], "repo string, authorship string")).groupBy("authorship").agg(F.count("*").alias("n")),
    "v02_notes": lambda s, p: _states(s, p),
    "a08_note_stats": lambda s, p: history.note_stats(_states(s, p)),
    "l02_lifecycle": lambda s, p: history.lifecycle(d.revisions(s, p), _dissolutions(s, p), _materializations(s, p)),
    "l03_audit": lambda s, p: history.audit(d.revisions(s, p), _dissolutions(s, p), _materializations(s, p)),
    "v01_classified": lambda s, p: history.classified(d.revisions(s, p), _dissolutions(s, p)).groupBy(F.coalesce("deletion", F.lit("none")).alias("deletion")).agg(F.count("*").alias("n")),
    "r02_triple_deltas": lambda s, p: _deltas(_state_rows(s, p)),
    "r01_diffs": lambda s, p: history.diffs(d.revisions(s, p), d.revisions(s, p).select("commit_sha", "file_path", F.concat_ws("\n", "change_type", "captured_at").alias("body")).repartition("file_path").dropDuplicates(["commit_sha", "file_path"])),
    "k01_readiness": lambda s, p: skills.readiness(_disciplines(s, p), _practice(s, p), AS_OF),
    "k04_frontier": _frontier,
    "k05_ranked_actions": lambda s, p: skills.ranked_actions(_frontier(s, p), _actions(s, p)).select("label", "reason", "action", "score", "place"),
    "k06_snapshot": lambda s, p: skills.snapshot(skills.readiness_qualifiers(skills.readiness(_disciplines(s, p), _practice(s, p), AS_OF), AS_OF), ["readiness", "computed_at"]),
}


def _reach(s, p):
    t, n, _ = _graph(s, p)
    both = t.where("predicate in ('partOf', 'childOf')").withColumn("predicate", F.lit("up"))
    start = n.where("kind = 'supplier'").select("id")
    found = graph.reachable(both, start, "up", 2)
    return found.join(n.select(F.col("id").alias("node"), "kind", "label"), "node").groupBy("depth", "kind", "label").agg(F.count("*").alias("n"))


def _state_rows(s, p):
    return d.revisions(s, p).withColumn("statements", F.array("change_type", "authorship", F.substring("captured_at", 1, 4)))


def _deltas(states):
    return history.triple_deltas(states).withColumns({c: F.array_join(F.sort_array(c), ",") for c in ("added", "removed")})


ORACLES = {
    "g03_triples": f"WITH {_STATEMENTS} SELECT DISTINCT subject_kind, subject, predicate, CASE WHEN object IS NOT NULL THEN object_kind END AS object_kind, object, provenance FROM statements",
    "g01_nodes": f"WITH {_STATEMENTS} SELECT kind, min(label) AS label, lower(trim(label)) AS normalized_label FROM (SELECT subject_kind AS kind, subject AS label FROM statements UNION ALL SELECT object_kind, object FROM statements WHERE object IS NOT NULL) GROUP BY kind, lower(trim(label))",
    "g04_query_triples": f"WITH {_STATEMENTS} SELECT 'forward' AS direction, subject_kind, subject, predicate, object FROM statements WHERE predicate = 'partOf' AND object = 'NATION_3'",
    "g05_with_inverse": f"WITH {_STATEMENTS} SELECT 'forward' AS direction, subject, predicate, object_kind, object FROM statements WHERE subject = 'NATION_3' UNION ALL SELECT 'inverse', object, CASE predicate WHEN 'partOf' THEN 'hasPart' ELSE 'parentOf' END, subject_kind, subject FROM statements WHERE object = 'NATION_3'",
    "g06_neighborhood": f"WITH {_STATEMENTS} SELECT DISTINCT * FROM (SELECT 'out' AS direction, predicate, object_kind AS kind, object AS label FROM statements WHERE subject_kind = 'nation' AND lower(subject) = 'nation_3' UNION ALL SELECT 'in', predicate, subject_kind, subject FROM statements WHERE object_kind = 'nation' AND lower(object) = 'nation_3') ORDER BY direction, predicate, label NULLS FIRST, kind LIMIT 60",
    "g07_predicates": "SELECT * FROM (VALUES ('childOf', 'parentOf', FALSE), ('relatesTo', 'relatesTo', TRUE), ('sentTo', 'receivedFrom', FALSE)) t(name, inverse, \"symmetric\")",
    "g06_reachable": "SELECT 0 AS depth, 'supplier' AS kind, s_name AS label, count(*) AS n FROM supplier GROUP BY s_name UNION ALL SELECT 1, 'nation', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 2, 'region', r_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "a06_graph_totals": f"WITH {_STATEMENTS} SELECT (SELECT count(DISTINCT (kind, lower(label))) FROM (SELECT subject_kind AS kind, subject AS label FROM statements UNION ALL SELECT object_kind, object FROM statements WHERE object IS NOT NULL)) AS nodes, (SELECT count(*) FROM statements) AS triples, (SELECT count(*) FROM statements WHERE object IS NULL) AS without_object",
    "a06_graph_usage": f"WITH {_STATEMENTS} SELECT predicate, count(*) AS n FROM statements GROUP BY 1",
    "a06_graph_kinds": f"WITH {_STATEMENTS} SELECT kind, count(DISTINCT lower(label)) AS n FROM (SELECT subject_kind AS kind, subject AS label FROM statements UNION ALL SELECT object_kind, object FROM statements WHERE object IS NOT NULL) GROUP BY 1",
    "g10_message_statements": with_views("recipients threads", "SELECT predicate, provenance, count(*) AS n, count(DISTINCT object) AS objects FROM (SELECT 'sentTo' AS predicate, source_table AS provenance, address AS object FROM recipients UNION ALL SELECT 'inThread', source_table, thread FROM threads) GROUP BY ALL"),
    "k07_depths": "WITH RECURSIVE t(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN nation ON n_nationkey > 0 AND (n_nationkey - 1) // 3 = node) SELECT node, max(depth) AS depth FROM t GROUP BY node",
    "e02_web_pages": f"WITH {_SIGHTINGS} SELECT normalized_url, arg_min(url, seq) AS url, arg_max(title, seq) FILTER (WHERE title <> '') AS title, arg_max(excerpt, seq) FILTER (WHERE excerpt <> '') AS excerpt, min(seen) AS first_seen, max(seen) AS last_seen FROM sightings GROUP BY 1",
    "e03_bookmarks": f"WITH {_SIGHTINGS} SELECT normalized_url, instrument, count(*) AS appearance_count, min(seen) AS first_seen, max(seen) AS last_seen FROM sightings GROUP BY ALL",
    "e01_last_known": "SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS a, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 5 = 0) AS b FROM orders GROUP BY 1",
    "e04_new_rows": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_orderkey % 2 <> 0 GROUP BY ALL",
    "e05_connections": f"WITH {_APPEARANCES} SELECT key, arg_max(name, export) AS name, min(friends_since) AS friends_since, max(export) AS last_export, CAST(count(DISTINCT export) AS INTEGER) AS exports FROM appearances GROUP BY 1",
    "e06_inactive": f"WITH {_APPEARANCES}, c AS (SELECT key, max(export) AS last_export FROM appearances GROUP BY 1) SELECT CASE WHEN last_export = '1998-08-02#000000001' THEN 'active' ELSE 'inferred_inactive' END AS status, count(*) AS n FROM c GROUP BY 1",
    "s06_row_loss": "WITH a AS (SELECT l_returnflag AS name, count(*) AS before FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS name, count(*) AS after FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber > 2 GROUP BY 1) SELECT name, before, coalesce(after, 0) AS after FROM a LEFT JOIN b USING (name) WHERE (before - coalesce(after, 0)) / before > 0.01",
    "u01_normalize_url": r"SELECT page_id, CASE WHEN contains(a, '?') THEN regexp_replace(a, '/+\?', '?') ELSE regexp_replace(a, '/+$', '') END AS normalized, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, 'ok' AS verdict FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:'), '\?utm_source=feed$', '') AS a FROM pages)",
    "c01_exact_copies": "WITH k AS (SELECT sha256(text) AS h, min(doc_id) AS a FROM documents GROUP BY 1) SELECT a, doc_id AS b, 'exact_content' AS rule, 0.99::DOUBLE AS confidence FROM documents JOIN k ON sha256(text) = h WHERE doc_id <> a",
    "c03_people_components": "WITH RECURSIVE " + with_views("people", "SELECT 1")[5:].rsplit(" SELECT 1", 1)[0] + f", {_KEYS}, cc(x, y) AS (SELECT id, id FROM people UNION SELECT cc.x, e.y FROM cc JOIN e ON e.x = cc.y) SELECT x AS id, min(y) AS survivor FROM cc GROUP BY x HAVING min(y) < x",
    "c04_applied": "WITH RECURSIVE " + with_views("people", "SELECT 1")[5:].rsplit(" SELECT 1", 1)[0] + f", {_KEYS}, cc(x, y) AS (SELECT id, id FROM people UNION SELECT cc.x, e.y FROM cc JOIN e ON e.x = cc.y), m AS (SELECT x, min(y) AS id FROM cc GROUP BY x) SELECT id, count(*) AS n FROM m GROUP BY id",
    "c06_places_near": with_views("places", f"WITH p AS (SELECT a.id AS a, b.id AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM places a JOIN places b ON a.id < b.id) SELECT a, b, 'geo_within_100m' AS rule, 0.85::DOUBLE AS confidence FROM p WHERE {_HAV} <= 100"),
    "r01_revisions": with_views("revisions", "SELECT * FROM revisions WHERE captured_at >= '2000' AND change_type = 'delete' ORDER BY captured_at DESC NULLS LAST, commit_sha DESC LIMIT 40"),
    "n02_latest_revision": with_views("revisions", "SELECT file_path, commit_sha, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY captured_at DESC, commit_sha DESC) AS n FROM revisions) WHERE n = 1"),
    "a07_revision_stats": with_views("revisions", "SELECT 'authorship' AS what, authorship AS name, count(*) AS n FROM revisions GROUP BY 2 UNION ALL SELECT 'change_type', change_type, count(*) FROM revisions GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM revisions"),
    "a07_summary_coverage": with_views("revisions", "SELECT count(*) AS total, count(summary) AS filled, round(count(summary) * 100 / count(*), 2) AS pct FROM revisions"),
    "a07_top_files": with_views("revisions", "SELECT file_path, count(*) AS n FROM revisions GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10"),
    "a07_by_day": with_views("revisions", "SELECT substr(captured_at, 1, 10) AS day, count(*) AS n FROM revisions GROUP BY 1 ORDER BY day DESC LIMIT 14"),
    "r03_summary_queue": with_views("revisions", "WITH r AS (SELECT commit_sha, min(file_path) AS file_path, min(captured_at) AS captured_at, min(change_type) AS change_type, min(size_bytes) AS size_bytes, min(summary) AS summary FROM revisions GROUP BY 1), q AS (SELECT *, CASE WHEN change_type IN ('rename', 'delete') OR size_bytes > 5120 THEN 'small' ELSE 'large' END AS model FROM r WHERE summary IS NULL) SELECT commit_sha, model, CAST((row_number() OVER (PARTITION BY model ORDER BY captured_at, commit_sha) - 1) // 10 AS BIGINT) AS bundle FROM q"),
    "r04_skipped": with_views("revisions", "SELECT coalesce(CASE WHEN summary IS NULL AND file_path ILIKE 'VAULT/1%.md' THEN 'skipped' ELSE summary END, 'none') AS summary, count(*) AS n FROM revisions GROUP BY 1"),
    "k03_authorship": with_views("revisions", "WITH c AS (SELECT commit_sha, min(authorship) AS a FROM revisions WHERE size_bytes % 3 = 0 GROUP BY 1) SELECT coalesce(a, 'ai-generated') AS authorship, count(*) AS n FROM revisions LEFT JOIN c USING (commit_sha) GROUP BY 1"),
    "v02_notes": with_views("revisions", f"WITH {_DISS}, {_NOTES} SELECT * FROM states"),
    "a08_note_stats": with_views("revisions", f"WITH {_DISS}, {_NOTES} SELECT status, count(*) AS n, CAST(sum(revisions) AS BIGINT) AS revisions FROM states GROUP BY 1"),
    "l02_lifecycle": with_views("revisions", f"WITH {_DISS} SELECT file_path, captured_at AS at, 'revision:' || change_type AS event, commit_sha AS ref FROM revisions UNION ALL SELECT file_path, dissolved_at, 'dissolution', dissolution_id FROM dissolutions UNION ALL SELECT file_path, materialized_at, 'materialization', CAST(run_id AS VARCHAR) FROM materializations"),
    "l03_audit": with_views("revisions", f"WITH {_DISS} SELECT 'dissolution_without_revision' AS \"check\", 'error' AS severity, count(*) AS n FROM dissolutions d WHERE NOT EXISTS (FROM revisions r WHERE r.file_path = d.file_path AND r.commit_sha = d.commit_sha) UNION ALL SELECT 'dissolution_of_no_deletion', 'error', count(*) FROM dissolutions d WHERE EXISTS (FROM revisions r WHERE r.file_path = d.file_path AND r.commit_sha = d.commit_sha AND r.change_type <> 'delete') UNION ALL SELECT 'unexplained_deletion', 'warning', count(*) FROM revisions r WHERE change_type = 'delete' AND NOT EXISTS (FROM dissolutions d WHERE r.file_path = d.file_path AND r.commit_sha = d.commit_sha) UNION ALL SELECT 'dissolution_without_reason', 'warning', count(*) FROM dissolutions WHERE trim(reason) = '' UNION ALL SELECT 'dissolution_without_targets', 'info', count(*) FROM dissolutions WHERE target_tables = '[]' UNION ALL SELECT 'materialization_of_unknown_path', 'warning', count(*) FROM materializations m WHERE NOT EXISTS (FROM revisions r WHERE r.file_path = m.file_path)"),
    "v01_classified": with_views("revisions", f"WITH {_DISS} SELECT CASE WHEN change_type <> 'delete' THEN 'none' WHEN dissolution_id IS NOT NULL THEN 'dissolved' ELSE 'unexplained' END AS deletion, count(*) AS n FROM revisions LEFT JOIN dissolutions USING (file_path, commit_sha) GROUP BY 1"),
    "k01_readiness": f"WITH {_DISC}, practice AS (SELECT n_name AS label, sum(0.05 * exp(-ln(2) / 180 * greatest(0, (epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400.0))) AS lift FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), x AS (SELECT d.label, baseline, lift, exp(-ln(2) / 180 * greatest(0, (epoch(TIMESTAMP '2002-01-01') - epoch(asserted_at::TIMESTAMP)) / 86400.0)) AS f FROM disciplines d LEFT JOIN practice USING (label)) SELECT label, CASE WHEN baseline IS NOT NULL OR lift IS NOT NULL THEN round(least(1.0, greatest(coalesce(baseline * 0.05, 0), coalesce(baseline * f, 0) + coalesce(lift, 0))), 4) END AS readiness, CASE WHEN baseline IS NOT NULL THEN greatest(baseline * 0.05, baseline * f) < baseline * 0.5 END AS atrophied FROM x",
    "r02_triple_deltas": with_views("revisions", "WITH s AS (SELECT repo, file_path, commit_sha, captured_at, CASE WHEN change_type = 'delete' THEN [] ELSE [change_type, authorship, substr(captured_at, 1, 4)] END AS now FROM revisions), w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY repo, file_path ORDER BY captured_at, commit_sha), []) AS was FROM s) SELECT repo, file_path, commit_sha, array_to_string(list_sort(list_distinct(list_filter(now, lambda x: NOT list_contains(was, x)))), ',') AS added, array_to_string(list_sort(list_distinct(list_filter(was, lambda x: NOT list_contains(now, x)))), ',') AS removed FROM w"),
    "k04_frontier": f"WITH {_FRONT} SELECT * FROM frontier",
    "k05_ranked_actions": f"WITH {_FRONT}, {_ACT}, s AS (SELECT label, reason, action, round((est_value - cost + novelty) * p_action, 6) AS score FROM frontier JOIN actions USING (label)) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, action) AS INTEGER) AS place FROM s",
}
