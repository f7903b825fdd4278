"""Operators on small tables, with the edge cases of their rules."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, urls, values
from tessera.operators import coalesce, comm, components, coverage, embed, graph, history, merge, scoring, search, skills, writing


def one(spark, column, *given):
    schema = "a string" if len(given) == 1 else ", ".join(f"{n} string" for n, _ in zip("abcd", given, strict=False))
    return spark.createDataFrame([tuple(given)], schema).select(column.alias("x")).first().x


# functions


def test_query_parts():
    assert text.match_expression("the quick brown") == "quick AND brown"
    assert text.match_expression('say "hello world" now', "OR") == '"hello world" OR say OR now'
    assert text.match_expression("don't well-known the and") == "dont"
    assert text.match_expression('"" the') == "" and text.match_expression("") == ""


def test_chunks():
    assert text.chunks_of("  ") == [] and text.chunks_of(" a ") == ["a"]
    assert text.chunks_of("x" * 2048) == ["x" * 2048]
    got = text.chunks_of("x" * 5000)
    assert [len(c) for c in got] == [2048, 2048, 1304]
    paragraphs = "a" * 1800 + "\n\n" + "b" * 1800
    assert text.chunks_of(paragraphs)[0] == "a" * 1800
    assert text.chunks_of("a" * 2000 + ". " + "b" * 500)[0].endswith("a.")
    words = "word " * 1000
    assert all(len(c) <= 2048 for c in text.chunks_of(words)) and text.chunks_of(words)[1][:4] in "word word"


def test_text_columns(spark):
    assert one(spark, text.wikilinks(F.col("a")), "[[A|x]] [[B#h]] [[A]] [[ ]]") == ["A", "B"]
    assert one(spark, text.concepts(F.col("a")), "The Rust-lang and rust-lang of x-ray ab") == ["rust-lang", "x-ray"]
    assert [one(spark, text.e164(F.col("a")), x) for x in ("(555) 010-0000", "1 555 010 0000", "+44 20", "12", " - ")] == ["+15550100000", "+15550100000", "+4420", "12", None]
    assert one(spark, text.redacted(F.col("a"), [r"\d{3}-\d{4}"], ["Bob"]), "bob 555-1234") == "[REDACTED] [REDACTED]"
    assert one(spark, text.folded(F.col("a")), "  Éva  Ñ ") == "eva n"
    assert one(spark, text.snippet(F.col("a"), 5), "\n a\nbcdefg") == "a bcd"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/a/?utm_source=x&b=2#f", "https://example.com/a?b=2"),
        ("https://e.com:443/", "https://e.com"),
        ("https://e.com/a?b=&c", "https://e.com/a?b="),
        ("https://e.com/?q=a%20b+c&GCLID=1", "https://e.com?q=a+b+c"),
        ("  ", ""),
        ("not a url", "not a url"),
        ("https://e.com/?x=~*", "https://e.com?x=~%2A"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("a")), url) == want


def test_url_ladders(spark):
    verdicts = {"https://www.gmail.com/": "junk:gmail-root", "http://localhost:8080/x": "junk:localhost", "about:blank": "junk:browser-internal", "": "junk:empty-url", "https://e.com": None, "http://mail.google.com/mail": "junk:gmail-inbox"}
    for url, want in verdicts.items():
        assert one(spark, urls.junk(F.col("a")), url) == want
    assert one(spark, urls.skip(F.col("a")), "https://www.google.com/search?q=x").startswith("skip:google-search")
    assert one(spark, urls.domain(F.col("a")), "https://e.com:8/x") == "e.com:8" and one(spark, urls.domain(F.col("a")), "x") is None
    assert one(spark, urls.youtube_video(F.col("a")), "https://youtu.be/abcdefghijk") == "abcdefghijk"


def test_values(spark):
    days = [one(spark, values.age_days(F.col("a"), "2020-01-11 00:00:00"), x) for x in ("2020-01-01", "2020-01-01T12:00:00Z", "2020-01-01T00:00:00+02:00", "2021-01-01", "bad", None)]
    assert [round(d, 4) for d in days] == [10, 9.5, 10.0833, 0, 0, 0]
    assert one(spark, values.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), "x") == pytest.approx(6_371_000 * math.pi / 180)
    assert one(spark, values.haversine_m(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)), "x") == 0
    years = [one(spark, F.year(values.ambiguous_seconds(F.lit(x))), "x") for x in (1_500_000_000, 600_000_000, 5)]
    assert years == [2017, 2020, 2001]
    assert one(spark, values.decay(F.lit(730.0), values.rate(F.lit(730.0))), "x") == pytest.approx(0.5)
    assert one(spark, values.decay(F.lit(99.0), values.rate(F.lit(-1.0))), "x") == 1


# search


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "apple pie and apple tart", "2015-01-01", 0, "message"), (2, "apple", "2016-01-01", None, None), (3, "pie crust", "2016-05-01", 1, "message"), (4, "Apple pie", "2017-01-01", 0, "meta"), (5, None, None, 0, "message"), (6, "pear", "2017", 0, "message")]
    return spark.createDataFrame([(i, "documents", i, "t", c, d, b, k) for i, c, d, b, k in rows], "id long, source_table string, source_id long, title string, content string, date_sent string, is_bulk int, kind string")


def test_text_search(spark, chunks):
    ids = lambda df: [r.id for r in df.collect()]
    assert sorted(ids(search.bm25_search(chunks, "apple pie", 10))) == [1, 4]
    assert sorted(ids(search.bm25_search(chunks, '"apple pie"', 10))) == [1, 4] and ids(search.bm25_search(chunks, '"pie apple"', 10)) == []
    assert sorted(ids(search.bm25_search(chunks, "apple", 10, since="2016"))) == [2, 4] and ids(search.bm25_search(chunks, "pear", 10, until="2017-01")) == [6]
    assert ids(search.bm25_search(chunks, "the of", 10)) == []
    rows, label = search.text_search(chunks, "apple pie", 10)
    assert label.startswith("OR (4") and [r["rank"] for r in rows.collect()] == [1, 2, 3, 4]
    assert ids(search.bm25_postings(search.postings(chunks), search.lengths(chunks), ["apple"], 10)) == ids(search.bm25_search(chunks, "apple", 10))


def test_fusion_and_hybrid(spark, chunks):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = search.rrf_fuse(a, b).collect()
    assert [r.id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 7)], "id long, embedding array<float>")
    near = search.nearest_neighbors(vectors, 3, 2).collect()
    assert [(r.id, r.distance, r["rank"]) for r in near] == [(2, 1.0, 1), (4, 1.0, 2)]
    q = spark.createDataFrame([([6.0, 0.0],)], "embedding array<float>")
    assert [r.id for r in search.knn(vectors, q, 2, within=chunks.where("id < 4")).collect()] == [3, 2]
    hybrid = search.search(chunks, "apple pie", vectors, q, k=3).collect()
    assert {r.id for r in hybrid} <= {1, 2, 5, 6} and len(hybrid) == 3
    assert {r.id for r in search.search(chunks, "apple pie", k=10, include_bulk=True, include_meta=True).collect()} == {1, 2, 3, 4}
    scores = spark.createDataFrame([(1, 0.1)], "id long, score double")
    weighted = {r.id: (r.score, r.decay_score) for r in search.search(chunks, "apple", scores=scores, k=10).collect()}
    assert weighted[1][1] == 0.1 and weighted[2][1] == 1.0
    with pytest.raises(ValueError):
        search.search(chunks, "x", mode="semantic")
    assert [r.id for r in search.knn_bucketed(vectors, [6.0, 0.0], 2).collect()][0] == 6


def test_year_weights(spark):
    counts = spark.createDataFrame([("2015", 100), ("2016", 1), ("2017", 1)], "year string, n long")
    got = {r.year: r.weight for r in search.year_weights(counts).collect()}
    assert got == {"2015": 0.5, "2016": 1.0, "2017": 1.0}


# messages


@pytest.fixture(scope="module")
def mail(spark):
    schema = "source_table string, id long, subject string, sender_address string, sender_name string, direction string, date_sent string, is_bulk int, thread_id string, kind string, body_text string"
    rows = [("emails", 1, "Hi", "ann@x", "Ann", "inbound", "2020-01-01T10:00:00", 0, "t", None, "b"), ("emails", 2, "Re: Hi", "me@x", None, "outbound", "2020-01-02T10:00:00", 0, "t", None, "b"), ("chat_messages", 1, None, "ann@x", "Ann", "inbound", "2020-01-31T09:00:00", 0, None, None, "c"), ("chat_messages", 3, None, "me@x", "", "outbound", "2020-01-31T08:00:00", 0, None, None, "c"), ("emails", 4, "News", "bot@x", "Bot", "inbound", None, 1, None, None, "b"), ("emails", 5, "N", "me@x", "Me", "self", "2021-01-01T00:00:00", None, None, None, "b")]
    return spark.createDataFrame(rows, schema), spark.createDataFrame([("emails", 2, "Ann@x"), ("chat_messages", 3, "Ann@x")], "source_table string, id long, address string"), spark.createDataFrame([("chat_messages", 1, "c"), ("chat_messages", 3, "c")], "source_table string, id long, thread string")


def test_messages(spark, mail):
    m, to, threads = mail
    got = comm.get_message(m, to, None, 1).collect()
    assert [(r.source_table, r.recipients) for r in got] == [("emails", [])]
    assert comm.get_message(m, to, None, 99).count() == 0 and comm.get_message(m, to, None, 1, "chat_messages").first().source_table == "chat_messages"
    emails = m.where("source_table = 'emails'")
    assert [r.msg_id for r in comm.get_thread(emails, msg_id=2).collect()] == [1, 2] and comm.get_thread(emails, msg_id=5).count() == 0
    with pytest.raises(ValueError):
        comm.get_thread(emails)
    chat = m.where("source_table = 'chat_messages'")
    talk = comm.get_conversation(chat, to, threads, "ann").collect()
    assert [(r.msg_id, r.direction) for r in talk] == [(1, "inbound"), (3, "outbound")]
    assert comm.get_conversation(chat, to, threads, "ann", until="2020-01-31").count() == 0
    contacts = spark.createDataFrame([("Annie", "ANN@x")], "display_name string, address string")
    assert comm.get_conversation(chat, to, threads, "annie", contacts=contacts).count() == 2
    assert comm.stats_by_year(m).where("year is null").first().messages == 1
    assert {r.sender_address for r in comm.top_senders(m).collect()} == {"ann@x", "me@x"}


def test_participants(spark, mail):
    m, to, _ = mail
    got = {(r.source_table, r.msg_id): r.matched_via for r in comm.find_messages_by_participant(m, to, "ANN").collect()}
    assert got == {("emails", 1): "sender", ("emails", 2): "recipient", ("chat_messages", 1): "sender", ("chat_messages", 3): "recipient"}
    assert comm.find_messages_by_participant(m, to, "ann", "sender", "outbound").count() == 0
    assert comm.find_messages_by_participant(m, to, "bot", include_bulk=True).count() == 1 and comm.find_messages_by_participant(m, to, "bot").count() == 0
    with pytest.raises(ValueError):
        comm.find_messages_by_participant(m, to, "x", "cc")
    (t,) = comm.find_threads_by_subject(m, "hi").collect()
    assert (t.message_count, t.date_first[:10], t.date_last[:10]) == (2, "2020-01-01", "2020-01-02")
    assert [(r.address, r.message_count) for r in comm.top_correspondents(m, to, "both").collect()] == [("Ann@x", 2), ("ann@x", 2), ("me@x", 2)]
    with pytest.raises(ValueError):
        comm.top_correspondents(m, to, "none")


# writing, scores, coverage


def test_writing(spark):
    rows = [("s", "n", 10, 1, "change", "input.type", 5, 0), ("s", "n", 30, 2, "change", "undo", 0, 2), ("s", "n", 20, 3, "selection", None, 0, 0), ("u", "m", 5, 4, "change", "input.paste", 0, 7)]
    d = spark.createDataFrame(rows, "session_id string, note_path string, ts long, seq long, event_type string, user_event string, inserted long, deleted long")
    s = writing.sessions(d)
    (r,) = writing.writing_arc(s, "n").collect()
    assert (r.duration_ms, r.rewrite_ratio, r.doc_change_count, r.undo_count) == (20, 0.4, 2, 1)
    assert writing.writing_arc(s, "m").first().rewrite_ratio == 0
    assert [(r.part, r.position, r.seq) for r in writing.session_detail(d, "s", 2).orderBy("part", "position").collect()] == [("first", 1, 1), ("first", 2, 3), ("last", 1, 3), ("last", 2, 2), ("reversal", 1, 2)]
    assert writing.day_ms("1970-01-02") == 86_400_000 and writing.day_ms("1970-01-01", True) == 86_400_000 and writing.day_ms("x") is None
    assert writing.writing_stats(s, until="1969-12-31").first().session_count == 0
    two = writing.merged_sessions(writing.sessions(d.where("ts < 20")), writing.sessions(d.where("ts >= 20")))
    assert sorted(map(tuple, two.select(*s.columns).collect())) == sorted(map(tuple, s.collect()))


def test_scores(spark):
    policy = scoring.Policy(by_source_kind={"k": "fast"}, by_schema_type={"T": "evergreen"})
    rows = [(1, "2020-01-01", "k", None, None), (2, "2020-01-01", "k", "T", None), (3, "2020-01-01", "k", "T", "warm"), (4, "1900-01-01", "k", None, "nonsense"), (5, None, None, None, None)]
    c = spark.createDataFrame(rows, "id long, date_sent string, source_kind string, schema_type string, tier_override string")
    e = spark.createDataFrame([(1, "2020-07-01")] * 2, "chunk_id long, engaged_at string")
    got = {r.id: r for r in scoring.scores(c, e, policy, "2020-07-01 00:00:00").collect()}
    assert [got[i].tier for i in range(1, 6)] == ["fast", "evergreen", "warm", "fast", "standard"]
    assert got[1].score == pytest.approx(0.5 + 0.2, abs=1e-6) and got[2].score == 1 and got[4].score == 0.05 and got[5].score == 1
    assert scoring.populated(c, scoring.scores(c.where("id < 3"), e, policy, "2020-07-01 00:00:00"), policy, "2020-07-01 00:00:00").count() == 5


def test_coverage(spark):
    rules = {"source_kind": {"k": "health"}, "schema_type": {"EmailMessage": "social", "T": "money"}, "sender_domain": {"bank.com": "money"}}
    rows = [(2000, "k", "T", None), (2000, None, "EmailMessage", " BANK.com "), (2001, None, "EmailMessage", "z"), (2001, None, None, "bank.com"), (1979, "k", None, None), (None, "k", None, None), (2001, None, "X", None)]
    r = spark.createDataFrame(rows, "year int, a string, b string, c string")
    r = r.withColumn("domain", coverage.classified(F.col("a"), F.col("b"), F.col("c"), rules))
    assert [x.domain for x in r.collect()][:4] == ["health", "money", "social", "money"]
    cells = coverage.matrix(r, ["health", "money", "social", "home", "unclassified"])
    got = {(x.year, x.domain): (x.n, x.sparsity) for x in cells.collect()}
    assert len(got) == 10 and got[2001, "home"] == (0, 1.0) and got[2000, "money"] == (1, 0.0) and got[2000, "social"] == (0, 1.0)
    assert coverage.summary(cells).first().unclassified_pct == 25.0
    assert [(x.year, x.domain) for x in coverage.thinnest(cells).collect()] == [(2000, "money"), (2001, "money"), (2001, "social")]
    assert coverage.grown(100, 110) and not coverage.grown(100, 109) and coverage.grown(10**9, 10**9 + 10**6)


# graph, merging, identity


def test_graph(spark):
    st = spark.createDataFrame([("a", " X ", "childOf", "a", "y", "p", None), ("a", "x", "childOf", "a", "Y", "p", None), ("a", "x", "mentions", "a", None, "p", None), ("a", "x", "bogus", "a", "y", "p", None), ("a", "x", "relatesTo", "a", "z", "p", "r")], ", ".join(f"{c} string" for c in graph.STATEMENT))
    known = graph.predicates(spark)
    with pytest.raises(Exception, match="unknown predicate: bogus"):
        graph.add_triples(st, known).count()
    t = graph.add_triples(st.where("predicate <> 'bogus'"), known)
    n = graph.resolve_nodes(st.select(F.col("subject_kind").alias("kind"), F.col("subject").alias("label")).union(st.where("object is not null").select("object_kind", "object")))
    assert t.count() == 3 and n.count() == 3 and graph.unknown_predicates(st, known).first().predicate == "bogus"
    q = lambda **k: [(r.direction, r.predicate) for r in graph.query_triples(t, n, known, **k).collect()]
    assert q(subject="X") == [("forward", "childOf"), ("forward", "mentions"), ("forward", "relatesTo")]
    assert q(subject="y", include_inverse=True) == [("inverse", "parentOf")] and q(subject="z", include_inverse=True) == [] and q(subject="nobody") == []
    assert q(subject="x", limit=1, offset=1) == [("forward", "mentions")]
    assert len(graph.neighborhood(t, n, "a", "y").collect()) == 1
    d = graph.depths(spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "child string, parent string"))
    assert {r.node: r.depth for r in d.collect()} == {"a": 0, "b": 1, "c": 2}
    below = [(i + 1, i) for i in range(66)] + [(200, 201), (201, 200), (202, 201), (5, 0)]
    assert {r.node: r.depth for r in graph.depths(spark.createDataFrame(below, "child long, parent long")).collect()} == {i: i for i in range(67)}
    links = graph.wikilink_nodes(spark.createDataFrame([("Note",), ("Idea",)], "link string"), graph.resolve_nodes(spark.createDataFrame([("file", "note")], "kind string, label string")))
    assert {r.link: r.kind for r in links.collect()} == {"Note": "file", "Idea": "concept"}
    notes = spark.createDataFrame([("p.md", {"up": ["[[Top]]"], "tags": ["#t"], "predicate:supersedes": ["Old"], "x": ["y"]})], "path string, meta map<string, array<string>>")
    assert sorted((r.predicate, r.object) for r in graph.frontmatter_statements(notes).collect()) == [("childOf", "Top"), ("supersedes", "Old"), ("taggedWith", "t")]


def test_merging(spark):
    rows = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b"), ("k", 3, "c", None)], "key string, seq int, x string, y string")
    assert tuple(merge.last_known(rows, "key", "seq").select("x", "y").first()) == ("c", "b")
    assert merge.first_wins(rows, ["key"], [F.asc("seq")]).first().x == "a"
    assert merge.new_rows(rows, rows.limit(1), ["key"], [F.asc("seq")]).count() == 0
    pages = merge.web_pages(spark.createDataFrame([("u", "U1", "T", "", "2020", 1), ("u", "U2", "", "e", "2019", 2)], "normalized_url string, url string, title string, excerpt string, seen string, seq int")).first()
    assert (pages.url, pages.title, pages.excerpt, pages.first_seen, pages.last_seen) == ("U1", "T", "e", "2019", "2020")
    lost = merge.row_loss(spark.createDataFrame([("a", 100), ("b", 100), ("c", 5)], "name string, n long"), spark.createDataFrame([("a", 99), ("b", 98)], "name string, n long"))
    assert sorted(r.name for r in lost.collect()) == ["b", "c"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)] + [(20 + i, 21 + i) for i in range(20)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{20 + i: 20 for i in range(21)}}


def test_people(spark):
    rows = [(1, "A@x.com", None, "Al B"), (2, " a@X.com", "5550100000", "Al C"), (3, None, "(555) 010-0000", "Q"), (4, "", None, "Al B"), (5, None, None, "al b ")]
    p = spark.createDataFrame(rows, "id long, email string, phone string, full_name string")
    got = {r.id: (r.survivor, r.rule, r.decision) for r in coalesce.proposals(p, coalesce.PEOPLE, 0.9).collect()}
    assert got == {2: (1, "exact_email_local_domain", "auto"), 3: (1, "exact_email_local_domain", "auto")}
    named = {r.id: (r.survivor, r.decision) for r in coalesce.proposals(p.where("id > 3"), coalesce.PEOPLE).collect()}
    assert named == {5: (4, "review")}
    alias = coalesce.Rule("alias", "alias_list", ("full_name",), 0.9, "lowercase", aliases=("Q", "AL C"))
    assert [(r.a, r.b) for r in coalesce.candidate_pairs(p, (alias,)).collect()] == [(2, 3)]
    regex = coalesce.Rule("rx", "regex", ("full_name",), 0.9, pattern=r"^(\w+) B")
    assert [(r.a, r.b) for r in coalesce.candidate_pairs(p, (regex,)).collect()] == [(1, 4)]
    merges = coalesce.proposals(p, coalesce.PEOPLE, 0.9)
    assert sorted(r.id for r in coalesce.applied(p, "id", merges).collect()) == [1, 1, 1, 4, 5] and coalesce.unmerged(merges, 1).count() == 0
    f = coalesce.person_fields(p).where("id = 1").first()
    assert (f.email_domain, f.first_name, f.last_name) == ("x.com", "Al", "B")


def test_near_places_are_all_pairs(spark):
    import itertools
    import random

    r = random.Random(0)
    rows = [(i, f"n{i}", lat + r.uniform(-0.004, 0.004), r.uniform(-0.01, 0.01)) for i, lat in enumerate([0.0, 60.0, -75.0, 89.0] * 40)] + [(900, "x", None, 1.0), (901, "y", 95.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, name string, lat double, lon double")

    def metres(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows[:160], 2) if metres(a, b) <= 100}
    assert {(x.a, x.b) for x in coalesce.candidate_pairs(p, coalesce.PLACES[:1]).collect()} == want and want


def test_review(spark):
    pending = spark.createDataFrame([(2, 1, "r", 0.7, "review"), (3, 1, "r", 0.95, "auto"), (4, 1, "s", 0.6, "review")], "id long, survivor long, rule string, confidence double, decision string")
    queue = coalesce.review_queue(pending, spark.createDataFrame([], "signature string"))
    assert queue.count() == 2 and coalesce.review_queue(pending, queue).count() == 0
    signatures = {r.id: r.signature for r in queue.collect()}
    done, left = coalesce.reviewed(queue, spark.createDataFrame([(signatures[2], "reject"), (signatures[4], "defer")], "signature string, decision string"))
    assert done.count() == 0 and [r.id for r in left.collect()] == [4]


# history, skills, embedding


def test_history(spark):
    rows = [("r", "f", "1", "2020-01-01", "add", 10, None), ("r", "f", "2", "2020-01-02", "delete", 9000, None), ("r", "g", "3", "2020-01-03", "modify", 10, "s")]
    rev = spark.createDataFrame(rows, "repo string, file_path string, commit_sha string, captured_at string, change_type string, size_bytes long, summary string")
    assert {r.file_path: r.commit_sha for r in history.latest(rev).collect()} == {"f": "2", "g": "3"}
    diss = spark.createDataFrame([("f", "2", "d", "2020-01-02", "why", '["t"]'), ("q", "9", "e", "2020", "", "[]")], "file_path string, commit_sha string, dissolution_id string, dissolved_at string, reason string, target_tables string")
    mat = spark.createDataFrame([("zz", "2020", 1)], "file_path string, materialized_at string, run_id long")
    assert {r.check: r.n for r in history.audit(rev, diss, mat).collect()} == {"dissolution_without_revision": 1, "dissolution_of_no_deletion": 0, "unexplained_deletion": 0, "dissolution_without_reason": 1, "dissolution_without_targets": 1, "materialization_of_unknown_path": 1}
    assert {r.file_path: r.status for r in history.note_states(history.notes(rev), diss).collect()} == {"f": "dissolved", "g": "active"}
    assert {r.commit_sha: (r.model, r.bundle) for r in history.summary_queue(rev).collect()} == {"1": ("large", 0), "2": ("small", 0)}
    states = rev.withColumn("statements", F.when(F.col("commit_sha") == "1", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))))
    d = {r.commit_sha: (r.added, r.removed) for r in history.triple_deltas(states).collect()}
    assert d["1"] == (["a", "b"], []) and d["2"] == ([], ["a", "b"])
    commits = spark.createDataFrame([("1", "x\nCo-Authored-By: Some Bot <noreply@x>"), ("2", "fix")], "commit_sha string, message string")
    assert {r.commit_sha: r.authorship for r in history.classify_commits(commits).collect()} == {"1": "ai-coauthored", "2": "owner-authored"}
    blobs = spark.createDataFrame([("1", "f", "a\nb"), ("2", "f", "a\nc")], "commit_sha string, file_path string, body string")
    assert "-b" in {r.commit_sha: r.diff for r in history.diffs(rev, blobs).collect()}["2"]
    assert history.skipped(rev, ["F"]).where("summary = 'skipped'").count() == 2 and [x.count() for x in history.without_commit(rev, rev, "1")] == [2, 2]


def test_skills(spark):
    d = spark.createDataFrame([("a", 0.8, "2020-01-01"), ("b", None, None), ("c", None, None)], "label string, baseline double, asserted_at string")
    p = spark.createDataFrame([("b", "2020-06-29")] * 30, "label string, at string")
    got = {r.label: (r.readiness, r.atrophied) for r in skills.readiness(d, p, "2020-06-29 00:00:00").collect()}
    assert got == {"a": (0.4, False), "b": (1.0, None), "c": (None, None)}
    nodes = spark.createDataFrame([("a", None, None), ("b", 0.9, "2020-06-01"), ("c", 0.9, "bad"), ("d", 0.1, "2020-06-01"), ("e", None, None), ("f", None, None)], "label string, readiness double, last_verified string")
    pre = spark.createDataFrame([("d", "e"), ("b", "f"), ("d", "f"), ("zzz", "a")], "subject string, object string")
    assert {r.label: r.reason for r in skills.frontier(nodes, pre, "2020-07-01 00:00:00").collect()} == {"c": "under-informed", "d": "below-threshold", "f": "unaddressed"}
    acts = spark.createDataFrame([("c", "x", 1.0, 0.5, 0.0, 1.0), ("c", "y", 1.0, 0.0, 0.0, 0.9)], "label string, action string, est_value double, cost double, novelty double, p_action double")
    assert [(r.action, r.place) for r in skills.ranked_actions(nodes.where("label = 'c'").select("label"), acts).orderBy("place").collect()] == [("y", 1), ("x", 2)]


def test_embedding(spark):
    rows = spark.createDataFrame([("emails", 1, "s", "w " * 40, 0), ("emails", 2, "s", "short", 0), ("emails", 3, "s", "w " * 40, 1), ("chat_messages", 1, None, "v " * 3000, None)], "source_table string, id long, subject string, body_text string, is_bulk int")
    none = spark.createDataFrame([], "id long, source_table string, source_id long")
    want = embed.pending(rows, none)
    assert sorted((r.source_table, r.id) for r in want.collect()) == [("chat_messages", 1), ("emails", 1)]
    chunks = embed.cut(want)
    assert chunks.where("source_table = 'chat_messages'").count() == 4 and embed.pending(rows, chunks).count() == 0
    vectors = embed.embedded(chunks, embed.hashing_provider(8))
    assert vectors.count() == 5 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors.collect())
    assert {r.source_table: (r.eligible, r.done, r.chunks, r.embedded) for r in embed.status(rows, chunks, vectors).collect()} == {"emails": (1, 1, 1, 1), "chat_messages": (1, 1, 4, 4)}

    def picky(texts):
        if len(texts) > 1 or "v v" in texts[0]:
            raise RuntimeError
        return embed.hashing_provider(4)(texts)

    some = embed.embedded(chunks, picky).collect()
    assert len(some) == 5 and sum(r.embedding is not None for r in some) == 1 and {r.error for r in some if r.embedding is None} == {"RuntimeError()"}
    assert embed.status(rows, chunks, embed.embedded(chunks, picky)).agg(F.sum("embedded")).first()[0] == 1
    assert len(embed.query_vector(spark, embed.hashing_provider(8), "a river").first().embedding) == 8
    first = embed.limited([rows.where("source_table = 'emails'"), rows.where("source_table <> 'emails'")], 2)
    assert [(r.source_table, r.id) for r in first.collect()] == [("emails", 1), ("emails", 2)]


def test_diffs_are_those_of_difflib(monkeypatch):
    import difflib
    import random

    r, searched, real = random.Random(5), [], difflib.unified_diff
    whole = lambda a, b: "\n".join(real((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
    texts = [None, "", "x", "x\n", "x\n\ny", "\n", "x\r\ny"] + ["\n".join(r.choice("abcdefghijkl"[: r.choice((2, 4, 12))]) for _ in range(r.randint(0, 6))) for _ in range(120)]
    lines = [f"line {i}" for i in range(400)]
    for _ in range(60):
        i, k = sorted(r.sample(range(400), 2))
        texts.append("\n".join(lines[:i] + [f"new {r.random()}"] * r.randint(0, 3) + lines[k:]))
    for a in texts:
        for b in r.sample(texts, 25):
            assert history.diff_of(a, b) == whole(a, b), (a, b)
    monkeypatch.setattr(history.difflib, "unified_diff", lambda *a, **k: searched.append(a) or real(*a, **k))
    history.diff_of("modify\n1995-01-01", "modify\n1996-01-01"), history.diff_of(None, "add\n1995"), history.diff_of("add\n1", "delete\n2")
    assert not searched  # lines that can be matched in one way only aren't searched for


def test_chunks_and_vectors_hold_a_part_of_a_batch(monkeypatch):
    import pyarrow as pa

    held, whole = [], text.chunks_of
    monkeypatch.setattr(text, "HELD", 100)
    monkeypatch.setattr(pa, "concat_arrays", lambda parts, real=pa.concat_arrays: held.append(len(parts)) or real(parts))
    texts = ["a b " * 10, None, "", "c " * 300] + ["d " * 20] * 7
    got = [x for part in text.chunked.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array([None], pa.string())])) for x in part.to_pylist()]
    assert got == [None if t is None else whole(t) for t in [*texts, None]]
    assert held == [6, 1]


def test_vectors_leave_python_by_batch(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    chunks = spark.createDataFrame([(1, "x")], "id long, content string")
    monkeypatch.setattr(type(chunks), "mapInArrow", lambda df, run, schema: seen.append(run) or df)
    embed.embedded(chunks, embed.hashing_provider(4), batch=3)
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(8), pa.int64()), "content": [f"w{i}" for i in range(8)]})
    parts = list(seen[0](iter([rows])))
    assert [x.num_rows for x in parts] == [3, 3, 2] and [i for x in parts for i in x.column("id").to_pylist()] == list(range(8))
